"""Microfinance layout (CDF 2.0): fixed-width header and trailer, delimited body, one physical line."""

from __future__ import annotations


from ..functions.dates import ddmmyyyy
from . import catalogues
from .model import Format, Segment, layout

_C = catalogues.CATALOGUES

# Field order and widths of every microfinance record.
HDR = Segment("HDR", layout("""
_segId | Segment Identifier | req width:3 default:HDR
_fileName | Submission File Name | req width:5 default:HMMFI
version | Layout Version | req width:3 default:1.9
memberId | Submitting MFI ID | req width:10
memberName | Submitting MFI Name | req width:30
branchId | Submitting Branch ID | width:10
reportingDate | Reported Date | date req width:8
creationDate | File Creation Date | date req width:8
orgStructure | Org Member Structure Indicator | width:3 codes:MFI_ORG_STRUCTURE
password | Password | req width:30
vendorId | System Vendor Identifier | width:30 default:INHOUSE
vendorVersion | Vendor System Version | width:30 default:INHOUSE
hdrReserved | Reserved | width:1
""", _C), encoding="fixed", cardinality="header")

TRL = Segment("TRL", layout("""
_segId | Segment Identifier | req width:3 default:TRL
_fileName | Submission File Name | req width:5 default:HMMFI
version | Layout Version | req width:3 default:1.9
memberId | Submitting MFI ID | req width:10
trlReserved | Reserved | width:20
""", _C), encoding="fixed", cardinality="trailer")

CNSCRD = Segment("CNSCRD", layout("""
memberIdentifier | Member Identifier | req
branchIdentifier | Branch Identifier | req
kendraIdentifier | Kendra/Centre Identifier | req
groupIdentifier | Group Identifier
memberName1 | Member Name 1 | req
memberName2 | Member Name 2
memberName3 | Member Name 3
alternateName | Alternate Name
birthDate | Member Birth Date | date req
age | Member Age | number req
ageAsOnDate | Age as on (years) | number req
gender | Gender | req codes:MFI_GENDER
maritalStatus | Marital Status | req codes:MFI_MARITAL_STATUS
keyPersonName | Key Person's Name | req
keyPersonRelationship | Key Person's Relationship | req codes:MFI_RELATIONSHIP
relName1 | Relationship Name 1
relType1 | Relationship Type 1 | codes:MFI_RELATIONSHIP
relName2 | Relationship Name 2
relType2 | Relationship Type 2 | codes:MFI_RELATIONSHIP
relName3 | Relationship Name 3
relType3 | Relationship Type 3 | codes:MFI_RELATIONSHIP
relName4 | Relationship Name 4
relType4 | Relationship Type 4 | codes:MFI_RELATIONSHIP
nomineeName | Nominee Name
nomineeRelationship | Nominee Relationship | codes:MFI_RELATIONSHIP
nomineeAge | Nominee Age | number
voterId | Voter ID
uid | UID (Aadhaar)
pan | PAN
rationCard | Ration Card
otherId1Type | Other ID 1 Type
otherId1Value | Other ID 1 Value
otherId2Type | Other ID 2 Type
otherId2Value | Other ID 2 Value
otherId3Type | Other ID 3 Type
otherId3Value | Other ID 3 Value
tel1Type | Telephone 1 Type
tel1Number | Telephone 1 Number
tel2Type | Telephone 2 Type
tel2Number | Telephone 2 Number
povertyIndex | Poverty Index | number
assetOwnership | Asset Ownership Indicator
numDependents | Number of Dependents | number
bankName | Bank Name
bankBranch | Bank Branch
bankAccount | Bank Account #
occupation | Occupation
monthlyFamilyIncome | Total Monthly Family Income | number
monthlyFamilyExpenses | Monthly Family Expenses | number
religion | Religion
caste | Caste
groupLeaderInd | Group Leader Indicator
centerLeaderInd | Center Leader Indicator
emailId | Email ID
cnsReserved | Reserved
""", _C, "CNSCRD"), flag=1, cardinality="one")

ADRCRD = Segment("ADRCRD", layout("""
permanentAddress | Permanent Address | req
permanentState | Permanent State Code | req codes:MFI_STATE
permanentPin | Permanent PIN Code | req
currentAddress | Current Address | req
currentState | Current State Code | req codes:MFI_STATE
currentPin | Current PIN Code | req
adrDummy | Dummy
adrReserved | Reserved
""", _C, "ADRCRD"), flag=2, cardinality="one")

ACTCRD = Segment("ACTCRD", layout("""
uniqueAccountRef | Unique Account Reference Number | req
accountNumber | Account Number | req
actBranchIdentifier | Branch Identifier | req
actKendraIdentifier | Kendra/Centre Identifier | req
loanOfficer | Loan Officer
dateOfAccountInfo | Date of Account Information | date req
loanCategory | Loan Category | req codes:MFI_LOAN_CATEGORY
actGroupIdentifier | Group Identifier
loanCycleId | Loan Cycle ID
loanPurpose | Loan Purpose | req
accountStatus | Account Status | req codes:MFI_ACCOUNT_STATUS
applicationDate | Application Date | date
sanctionedDate | Sanctioned Date | date
disbursedDate | Date Opened/Disbursed | date req
closedDate | Date Closed | date
lastPaymentDate | Date of Last Payment | date
appliedAmount | Applied For Amount | number
sanctionedAmount | Loan Amount Sanctioned | number req
disbursedAmount | Total Amount Disbursed | number req
numInstallments | Number of Installments | number req when:new_disbursal
repaymentFrequency | Repayment Frequency | req when:new_disbursal codes:MFI_REPAYMENT_FREQUENCY
installmentAmount | Installment Amount | number req when:new_disbursal
currentBalance | Current Balance | number req
amountOverdue | Amount Overdue | number req
dpd | Days Past Due
writeOffAmount | Write Off Amount | number
writeOffDate | Date Write-Off | date
writeOffReason | Write-off Reason
meetingsHeld | No. of Meetings Held | number
meetingsMissed | No. of Meetings Missed | number
insuranceIndicator | Insurance Indicator
insuranceType | Type of Insurance
sumAssured | Sum Assured | number
meetingDay | Agreed Meeting Day
meetingTime | Agreed Meeting Time
actDummy | Dummy
actReserved | Reserved
""", _C, "ACTCRD"), flag=3)

# Fixed value: loans disbursed on or after this day carry instalment details.
NEW_DISBURSAL_FROM = "2022-04-01"


def _hdr(m):
    return {
        "version": m("extras.version"),
        "memberId": m("member_id"),
        "memberName": m("member_name"),
        "branchId": m("extras.branch_id"),
        "reportingDate": ddmmyyyy(m("reporting_date")),
        "creationDate": ddmmyyyy(m("creation_date")),
        "orgStructure": m("extras.org_structure"),
        "password": m("password"),
        "vendorId": m("extras.vendor_id"),
        "vendorVersion": m("extras.vendor_version"),
    }


def _trl(c, m):
    return {"version": m("extras.version"), "memberId": m("member_id")}


CDF = Format(
    "mfi-cdf", "MFI CDF V2.0", "2.0", ".CDF", HDR, (CNSCRD, ADRCRD, ACTCRD), TRL, _hdr, _trl, one_physical_line=True,
)
