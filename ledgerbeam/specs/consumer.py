"""Consumer layouts: the tag-length-value stream and the flat concatenated form."""

from __future__ import annotations


from ..functions.dates import ddmmyyyy
from . import catalogues
from .model import FlatSheet, Format, Segment, layout

_C = catalogues.CATALOGUES

# Tag-length-value segments.
PN = Segment("PN", layout("""
name | Consumer Name / Surname | req tlv:01 cap:99 alias:name1
name2 | First Name | tlv:02 cap:99
name3 | Middle Name | tlv:03 cap:99
dateOfBirth | Date of Birth | date req tlv:07
gender | Gender | tlv:08 codes:CONSUMER_GENDER
""", _C), "tlv", 1, "one", "PN03N01")
ID = Segment("ID", layout("""
idType | ID Type | tlv:01 codes:CONSUMER_ID_TYPE
idNumber | ID Number | tlv:02 cap:30
""", _C), "tlv", 2, "one", "ID03I01")
PT = Segment("PT", layout("""
phoneNumber | Telephone Number | tlv:01
phoneType | Telephone Type | tlv:03 codes:CONSUMER_PHONE_TYPE
""", _C), "tlv", 3, "optional", "PT03T01")
EC = Segment("EC", layout("""
email | Email ID | tlv:01
""", _C), "tlv", 4, "optional", "EC03C01")
PA = Segment("PA", layout("""
addressLine1 | Address Line 1 | req tlv:01 cap:99
addressLine2 | Address Line 2 | tlv:02 cap:99
city | City/Town / Address Line 3 | tlv:03 cap:99 alias:addressLine3
stateCode | State Code | tlv:06 codes:CONSUMER_STATE
pinCode | PIN Code | tlv:07
addressCategory | Address Category | tlv:08
residenceCode | Residence Code | tlv:09
""", _C), "tlv", 5, "one", "PA03A01")
TL = Segment("TL", layout("""
memberId | Member Short Name / ID | req tlv:10
memberShortName | Member Short Name | tlv:02
accountNumber | Account Number | req tlv:03 cap:30
accountType | Account Type | tlv:04
ownershipIndicator | Ownership Indicator | tlv:05
dateOpened | Date Opened/Disbursed | date tlv:08
dateLastPayment | Date of Last Payment | date tlv:09
dateReported | Date Reported and Certified | date tlv:11
highCreditAmount | High Credit / Sanctioned Amount | number req tlv:12
currentBalance | Current Balance | number req tlv:13
amountOverdue | Amount Overdue | number tlv:14
suitFiledStatus | Suit Filed / Wilful Default Status | req tlv:21
assetClassification | Asset Classification | req tlv:26
rateOfInterest | Rate of Interest | number req tlv:38
repaymentTenure | Repayment Tenure | tlv:39
""", _C), "tlv", 6, "many", "TL04T00")
ES = Segment("ES", layout("_marker | End Marker | req width:6 default:ES02**"), "fixed", 7, "one")

TUDF_HEADER = Segment("TUDF", layout("""
_recordType | Record Type | req width:4 default:TUDF
version | Version | req width:2 default:12
memberId | Member / Processor User ID | req width:30
memberShortName | Member Short Name | width:16
cycleId | Cycle Identification | width:2
reportingDate | Date Reported & Certified | date req width:8 right
password | Reporting Password | width:30
authMethod | Authentication Method | width:1 default:L
futureUse | Future Use | width:5 default:00000
memberData | Member Data | width:48
""", _C), "fixed", cardinality="header")
TRLR = Segment("TRLR", layout("_marker | End marker | req width:4 default:TRLR"), "fixed", cardinality="trailer")

# Form columns by letter.
FORM_LETTERS = dict(
    pair.split(":")
    for pair in """
A:consumerName B:dateOfBirth C:gender D:pan P:mobile V:email X:address Y:stateCode Z:pinCode
AA:addressCategory AB:residenceCode AH:memberCode AI:memberShortName AJ:accountNumber AK:accountType
AL:ownershipIndicator AM:dateOpened AN:dateLastPayment AP:dateReported AQ:highCredit AR:currentBalance
AS:amountOverdue AT:daysPastDue AZ:suitFiled BB:assetClassification BG:rateOfInterest BH:repaymentTenure
BI:emiAmount
""".split()
)
FORM_DATES = ("dateOfBirth", "dateOpened", "dateLastPayment", "dateReported")


def _tudf(m):
    return {
        "memberId": m("member_id"),
        "memberShortName": m("member_short_name"),
        "cycleId": m("extras.cycle_id"),
        "reportingDate": ddmmyyyy(m("reporting_date")),
        "password": m("password"),
        "authMethod": m("extras.auth_method"),
    }


TUDF = Format(
    "consumer-tudf", "Consumer TUDF Format", "3.73", ".tudf", TUDF_HEADER, (PN, ID, PT, EC, PA, TL, ES), TRLR,
    _tudf, lambda c, m: {}, one_physical_line=True, line_end="", aliases=("consumer-ucrf12",),
    flat_sheet=FlatSheet(
        sheet="Data Submission Form", header_row=10, letters=FORM_LETTERS, match="letter", date_keys=FORM_DATES,
        header_cells={"A6": "member_name", "B6": "member_short_name", "C6": "cycle_id", "D6": "reporting_date",
                      "E6": "password"},
    ),
)

# The flat record, fields written back to back.
REC = Segment("REC", layout("""
consumerName | Consumer Name | req
dateOfBirth | Date of Birth | date req
gender | Gender | req codes:CONSUMER_GENDER
pan | Income Tax ID Number
mobile | Telephone No.Mobile
addressLine1 | Address Line 1 | req alias:Address_1
stateCode | State Code 1
pinCode | PIN Code 1
addressCategory | Address Category 1
residenceCode | Residence Code 1
memberCode | Current/New Member Code | req
memberShortName | Current/New Member Short Name
accountNumber | Curr/New Account No | req
accountType | Account Type
ownershipIndicator | Ownership Indicator
dateOpened | Date Opened/Disbursed | date
dateReported | Date Reported | date
highCredit | High Credit/Sanctioned Amt | number
currentBalance | Current Balance | number
amountOverdue | Amt Overdue | number
daysPastDue | No of Days Past Due | number
suitFiled | Suit Filed / Wilful Default | req
assetClassification | Asset Classification | req
rateOfInterest | Rate of Interest | req
""", _C), "concatenated", 1, "one")

FLAT_HEADER = Segment("TUDF", layout("""
_recordType | Record Type | req width:4 default:TUDF
memberId | Reporting Member / Processor ID | req width:30
memberShortName | Reporting Member Short Name | width:16
_filler1 | Filler | width:3
creationDate | Date Created | date width:8 right
_filler2 | Filler | width:12
reportingDate | Date Reported & Certified | date width:8 right
_filler3 | Filler | width:74
""", _C), "fixed", cardinality="header")


def _flat_header(m):
    return {
        "memberId": m("member_id"),
        "memberShortName": m("member_short_name"),
        "creationDate": ddmmyyyy(m("creation_date")),
        "reportingDate": ddmmyyyy(m("reporting_date")),
    }


# Labels of the form's own header block.
FORM_HEADER_LABELS = {"short name": "member_short_name", "date reported": "reporting_date",
                      "reporting password": "password"}

FLAT = Format(
    "consumer-ucrf12-flat", "Consumer UCRF-12", "3.73", ".txt", FLAT_HEADER, (REC,), None, _flat_header,
    glue_header=True, member_field="memberCode",
    flat_sheet=FlatSheet(
        sheet="Data Submission Form", header_row=10, match="exact",
        headers={name: f.key for f in REC.fields for name in (f.label, f.key, *f.aliases)},
        header_cells={"B6": "member_short_name", "D6": "reporting_date", "E6": "password"},
        date_keys=tuple(f.key for f in REC.fields if f.kind == "date"),
    ),
)
