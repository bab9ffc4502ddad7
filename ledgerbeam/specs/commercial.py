"""Commercial layouts (versions 3.9 and 3.10), template and Master-Sheet profiles."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from ..functions.dates import cycle_code, ddmmyyyy
from . import catalogues
from .model import FlatSheet, Format, Segment, layout

_C = catalogues.CATALOGUES

# Field order of every commercial record.
HD = Segment("HD", layout("""
memberId | Member ID | req
prevMemberId | Previous Member ID
creationDate | Date of Creation & Certification of Input File | date req
reportingDate | Reporting / Cycle Date | date req
infoType | Information Type | req codes:INFO_TYPE default:01
hdFiller | Filler
""", _C, "HD"), cardinality="header")

BS = Segment("BS", layout("""
memberBranchCode | Member Branch Code
prevMemberBranchCode | Previous Member Branch Code
borrowerName | Borrower Name | req
borrowerShortName | Borrower Short Name
bsReserved5 | Reserved
dateOfIncorporation | Date of Incorporation | date
pan | PAN
companyRegNumber | Company Registration Number
cin | CIN
tin | TIN
serviceTaxNo | Service Tax #
legalConstitution | Borrowers Legal Constitution | section:8.1
businessCategory | Business Category | section:8.2
businessIndustryType | Business/ Industry Type | section:8.3
classOfActivity1 | Class of Activity 1
classOfActivity2 | Class of Activity 2
classOfActivity3 | Class of Activity 3
sicCode | SIC Code
salesFigure | Sales Figure | number
financialYear | Financial Year
numberOfEmployees | Number of Employees | number
creditRating | Credit Rating
assessmentAgency | Assessment Agency / Authority | section:8.19
creditRatingAsOn | Credit Rating As On | date
creditRatingExpiry | Credit Rating Expiry Date | date
otherId | Other ID
bsFiller | Filler
""", _C, "BS"), flag=1, cardinality="one")

AS = Segment("AS", layout("""
officeLocationType | Borrower Office Location Type | section:8.4
officeDunsNumber | Borrower Office DUNS Number
addressLine1 | Address Line 1 | req
addressLine2 | Address Line 2
addressLine3 | Address Line 3
cityTown | City/Town
district | District
stateCode | State/Union Territory | section:8.5
pinCode | Pin Code
country | Country | section:8.15
mobileNumber | Mobile Number(s)
telAreaCode | Telephone Area Code
telNumber | Telephone Number(s)
faxAreaCode | Fax Area Code
faxNumber | Fax Number(s)
asFiller | Filler
asFiller2 | Filler
""", _C, "AS"), flag=2)

RS = Segment("RS", layout("""
relationshipDuns | Relationship DUNS Number
relatedType | Related Type
relationship | Relationship | req section:8.6
businessEntityName | Business Entity Name
rsBusinessCategory | Business Category | section:8.2
rsBusinessIndustryType | Business / Industry Type | section:8.3
namePrefix | Individual Name Prefix
fullName | Full Name
gender | Gender | req when:rs_individual
rsCompanyRegNumber | Company Registration Number
rsDateOfIncorporation | Date of Incorporation | date
dateOfBirth | Date of Birth | date
rsPan | PAN
voterId | Voter ID
passportNumber | Passport Number
drivingLicence | Driving Licence ID
uid | UID
rationCard | Ration Card No
rsCin | CIN
din | DIN
rsTin | TIN
rsServiceTax | Service Tax #
rsOtherId | Other ID
percentControl | Percentage of Control
rsAddressLine1 | Address Line 1
rsAddressLine2 | Address Line 2
rsAddressLine3 | Address Line 3
rsCity | City/Town
rsDistrict | District
rsStateCode | State/Union Territory | warn section:8.5
rsPinCode | Pin Code
rsCountry | Country | section:8.15
rsMobile | Mobile Number(s)
rsTelNumber | Telephone Number(s)
rsTelAreaCode | Telephone Area Code
rsFaxNumber | Fax Number(s)
rsFaxAreaCode | Fax Area Code
rsFiller | Filler
rsFiller2 | Filler
""", _C, "RS"), flag=3)

CR = Segment("CR", layout("""
accountNumber | Account Number | req
prevAccountNumber | Previous Account Number
sanctionDate | Facility / Loan Activation / Sanction Date | date req
sanctionedAmount | Sanctioned Amount/ Notional Amount of Contract | number req
currencyCode | Currency Code | req codes:CURRENCY default:INR section:8.7
creditType | Credit Type | section:8.8
tenure | Tenure / Weighted Average maturity period of Contracts
repaymentFrequency | Repayment Frequency | section:8.18
drawingPower | Drawing Power | number
currentBalance | Current Balance / Limit Utilized /Mark to Market | number
notionalOutstanding | Notional Amount of Out-standing Restructured Contracts | number
loanExpiryDate | Loan Expiry / Maturity Date | date
loanRenewalDate | Loan Renewal Date | date
assetClassification | Asset Classification/Number of days past due NDPD | req section:8.9
assetClassificationDate | Asset Classification Date | date
amountOverdue | Amount Overdue / Limit Overdue | number
overdueBucket01 | Overdue Bucket 01 ( 1 - 30 days) | number
overdueBucket02 | Overdue Bucket 02 ( 31 - 60 days) | number
overdueBucket03 | Overdue Bucket 03 ( 61 - 90 days) | number
overdueBucket04 | Overdue Bucket 04 (91 - 180 days) | number
overdueBucket05 | Overdue Bucket 05 (Above 180 days) | number
highCredit | High Credit | number
installmentAmount | Installment Amount | number
lastRepaidAmount | Last Repaid Amount | number
accountStatus | Account Status | section:8.10
accountStatusDate | Account Status Date | date
writtenOffAmount | Written Off Amount | number
settledAmount | Settled Amount | number
restructureReason | Major reasons for Restructuring
npaAmount | Amount of Contracts Classified as NPA | number
assetSecurityCoverage | Asset based Security coverage | section:8.16
guaranteeCoverage | Guarantee Coverage | section:8.17
bankRemarkCode | Bank Remark Code
wilfulDefaultStatus | Wilful Default Status
wilfulDefaultDate | Date Classified as Wilful Default | date
suitFiledStatus | Suit Filed Status | section:8.11
suitReferenceNumber | Suit Reference Number
suitAmount | Suit Amount in Rupees | number
dateOfSuit | Date of Suit | date
disputeId | Dispute ID No.
transactionTypeCode | Transaction Type Code
otherBk | OTHER_BK
ufceAmount | UFCE (Amount) | number
""", _C, "CR"), flag=4)

CR_V310 = replace(CR, fields=CR.fields + layout("ufceDate | UFCE Date | date"))

GS = Segment("GS", layout("""
gsDuns | Guarantor DUNS Number
gsRelatedType | Related Type
gsBusinessCategory | Business Category | section:8.2
gsBusinessIndustryType | Business / Industry Type | section:8.3
gsReserved5 | Reserved
gsNamePrefix | Individual Name Prefix
gsFullName | Full Name
gsGender | Gender | warn when:gs_individual
gsCompanyRegNumber | Company Registration Number
gsDateOfIncorporation | Date of Incorporation | date
gsDateOfBirth | Date of Birth | date
gsPan | PAN
gsVoterId | Voter ID
gsPassport | Passport Number
gsDrivingLicence | Driving Licence ID
gsUid | UID
gsRationCard | Ration Card No
gsCin | CIN
gsDin | DIN
gsTin | TIN
gsServiceTax | Service Tax #
gsOtherId | Other ID
gsAddressLine1 | Address Line 1 | warn
gsAddressLine2 | Address Line 2
gsAddressLine3 | Address Line 3
gsCity | City/Town
gsDistrict | District
gsStateCode | State/Union Territory | warn section:8.5
gsPinCode | Pin Code | warn
gsCountry | Country | section:8.15
gsMobile | Mobile Number(s)
gsTelNumber | Telephone Number(s)
gsTelAreaCode | Telephone Area Code
gsFaxNumber | Fax Number(s)
gsFaxAreaCode | Fax Area Code
gsPercentControl | Percentage of Control
gsFiller | Filler
""", _C, "GS"), flag=5)

SS = Segment("SS", layout("""
securityValue | Value of Security | number warn
ssCurrency | Currency | codes:CURRENCY default:INR section:8.7
securityType | Type of Security | section:8.13
securityClassification | Security Classification | warn section:8.14
securityDate | Date of Valuation
ssFiller | Filler
ssFiller2 | Filler
""", _C, "SS"), flag=6)

CD = Segment("CD", layout("""
dateOfDishonour | Date of Dishonour | date
dishonourAmount | Amount | number
instrumentNumber | Instrument / Cheque Number
timesDishonoured | Number of times dishonoured | number
chequeIssueDate | Cheque Issue Date | date
reasonForDishonour | Reason for Dishonour
cdFiller | Filler
""", _C, "CD"), flag=7)

TS = Segment("TS", layout("""
borrowerCount | Total Borrower Count | number req
accountCount | Total Account Count | number req
tsFiller | Filler
""", _C, "TS"), flag=99, cardinality="trailer")

# Constants that the Master Sheet does not carry.
BRANCH, REGISTERED_OFFICE, COUNTRY, RUPEES, NO_SUIT, RELATED_INDIVIDUAL = "HO", "01", "079", "INR", "00", "2"

# Master-Sheet header text and the input it feeds.
MASTER_HEADERS = dict(
    line.strip().rsplit(" = ", 1)
    for line in """
Borrower's Name = borrowerName
Borrower's PAN = pan
Borrowers Legal Constitution = legalConstitution
Business Category = businessCategory
Business/ Industry Type = businessIndustryType
Borrower's Address with PIN Code = address
Borrower's Contact No. = contactNo
Borrower's Account Number = accountNumber
Facility / Loan Activation / Sanction Date = sanctionDate
Sanctioned Amount/ Notional Amount of Contract = sanctionedAmount
Credit Type = creditType
Repayment Frequency = repaymentFrequency
Drawing Power = drawingPower
Current Balance / Limit Utilized = currentBalance
Asset Classification = assetClassification
Amount Overdue / Limit Overdue = amountOverdue
Account Status = accountStatus
Wilful Default Status = wilfulDefault
Date Classified as Wilful Default = wilfulDefaultDate
Suit Filed Status = suitFiledStatus
Suit Reference Number = suitReferenceNumber
Suit Amount in Rupees = suitAmount
Date of Suit = dateOfSuit
Relationship Type = relationshipType
Relationship = relationshipType
Related Person's Name = relatedName
Related Person's Gender = relatedGender
Related Person's Date of Birth = relatedDob
Related Person's PAN = relatedPan
Related Person's Address with PIN Code = relatedAddress
Related Person's Contact No = relatedContact
Value of Security = securityValue
Type of Security = securityType
Security Classification = securityClass
Borrower's Address Line 1 = borrowerAddressLine1
Borrower's Address Line 2 = borrowerAddressLine2
Borrower's Address Line 3 = borrowerAddressLine3
Borrower's City = borrowerCity
Borrower's District = borrowerDistrict
Borrower's State = borrowerState
Borrower's PIN = borrowerPin
Borrower's Mobile = borrowerMobile
Borrower's Landline STD Code = borrowerStdCode
Borrower's Landline Number = borrowerLandline
Related Person's Address Line 1 = relatedAddressLine1
Related Person's Address Line 2 = relatedAddressLine2
Related Person's Address Line 3 = relatedAddressLine3
Related Person's City = relatedCity
Related Person's District = relatedDistrict
Related Person's State = relatedState
Related Person's PIN = relatedPin
Related Person's Mobile = relatedMobile
Related Person's Landline STD Code = relatedStdCode
Related Person's Landline Number = relatedLandline
Company Registration Number = companyRegNumber
Date of Incorporation = dateOfIncorporation
CIN = cin
CLASS OF ACTIVITY = classOfActivity
Borrower Office DUNS Number = officeDuns
STATE CODE = borrowerState
Location Type = locationType
""".strip().splitlines()
)

# Column letters used when a header cannot be matched.
MASTER_LETTERS = dict(
    pair.split(":")
    for pair in """
A:borrowerName B:pan C:legalConstitution D:businessCategory E:businessIndustryType F:address G:contactNo
H:accountNumber I:sanctionDate J:sanctionedAmount K:creditType L:repaymentFrequency M:drawingPower
N:currentBalance P:assetClassification Q:amountOverdue R:accountStatus S:wilfulDefault T:suitFiledStatus
U:suitReferenceNumber V:suitAmount W:dateOfSuit X:relationshipType Y:relatedName Z:relatedGender
AA:relatedDob AB:relatedPan AC:relatedAddress AD:relatedContact
""".split()
)

# Wire field and the inputs it derives from, first one present wins.
WIRE_SOURCES = {
    "addressLine1": ("borrowerAddressLine1", "address"),
    "cityTown": ("borrowerCity", "address"),
    "stateCode": ("borrowerState", "address"),
    "pinCode": ("borrowerPin", "address"),
    "mobileNumber": ("borrowerMobile", "contactNo"),
    "rsAddressLine1": ("relatedAddressLine1", "relatedAddress"),
    "rsCity": ("relatedCity", "relatedAddress"),
    "rsStateCode": ("relatedState", "relatedAddress"),
    "rsPinCode": ("relatedPin", "relatedAddress"),
    "relationship": ("relationshipType",),
    "fullName": ("relatedName",),
    "dateOfBirth": ("relatedDob",),
    "rsPan": ("relatedPan",),
    "rsMobile": ("relatedMobile", "relatedContact"),
}

MASTER_DATES = ("sanctionDate", "wilfulDefaultDate", "dateOfSuit", "relatedDob", "dateOfIncorporation")

# Input keys of one guarantor block.
GUARANTOR_KEYS = (
    "type", "entityName", "fullName", "dob", "pan", "gender", "addressLine1", "addressLine2", "addressLine3",
    "address", "city", "district", "state", "pin", "mobile", "stdCode", "landline", "contact",
)


@dataclass(frozen=True)
class Profile:
    """What differs between the two Master-Sheet versions."""

    upper_prefix: bool
    padded_party_type: bool
    drawing_power_from_sanction: bool
    zero_wilful_date: bool
    emit_suit_details: bool = False


V39 = Profile(False, True, True, True)
V310 = Profile(True, False, False, False)


def _hd(m):
    return {
        "memberId": m("member_id"),
        "creationDate": ddmmyyyy(m("creation_date")),
        "reportingDate": ddmmyyyy(m("reporting_date")),
        "infoType": m("extras.info_type"),
    }


def _hd_cycle(m):
    return {**_hd(m), "infoType": F.coalesce(m("extras.info_type"), cycle_code(m("reporting_date")))}


def _ts(c, m):
    return {"borrowerCount": c("borrower_count").cast("string"), "accountCount": c("account_count").cast("string")}


def _master_body(cr: Segment) -> tuple[Segment, ...]:
    # An empty security record carries no currency; the wilful date slot may hold a plain "0".
    return (BS, AS, RS, cr.with_field("wilfulDefaultDate", kind="text"), GS, SS.with_field("ssCurrency", default=""), CD)


TEMPLATE_V39 = Format(
    "commercial-ucrf", "Commercial UCRF (Template)", "3.9", ".txt", HD, (BS, AS, RS, CR, GS, SS, CD), TS, _hd, _ts,
    borrower_rules=True, account_rule=True,
)
TEMPLATE_V310 = replace(
    TEMPLATE_V39, id="commercial-ucrf-v310", label="Commercial UCRF V3.10 (Template)", version="3.10",
    body=(BS, AS, RS, CR_V310, GS, SS, CD),
)
_MASTER_SHEET = FlatSheet(
    sheet="Master Sheet", header_row=10, headers=MASTER_HEADERS, letters=MASTER_LETTERS,
    header_cells={"B5": "member_id", "B6": "reporting_date", "B7": "creation_date"},
    sources=WIRE_SOURCES, date_keys=MASTER_DATES,
)
MASTER_V39 = replace(
    TEMPLATE_V39, id="commercial-ucrf-flat", label="Commercial UCRF V3.9 (Deprecated)", body=_master_body(CR),
    final_line_end=True, flat_sheet=_MASTER_SHEET, deprecated=True,
)
MASTER_V310 = replace(
    MASTER_V39, id="commercial-ucrf-flat-v310", label="Commercial UCRF V3.10", version="3.10",
    body=_master_body(CR_V310), header_values=_hd_cycle, deprecated=False,
)
