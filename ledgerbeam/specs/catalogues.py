"""Code catalogues published by the bureau. All values in this file are fixed values."""

from __future__ import annotations

from .model import code_table

# Currency codes.
CURRENCY = code_table("""
INR Indian Rupee
USD US Dollar
EUR Euro
GBP Pound Sterling
""")

# Header information types.
INFO_TYPE = code_table("""
01 Standard submission
02 Correction
ME Month End
W1 Week 1 (as on 9th)
W2 Week 2 (as on 16th)
W3 Week 3 (as on 23rd)
DL Daily
DC Data correction / Dispute
AH Adhoc submission
RR Data rejection resubmission
""")

# Commercial state codes.
COMMERCIAL_STATE = code_table("""
01 Andaman and Nicobar Islands
02 Andhra Pradesh
03 Arunachal Pradesh
04 Assam
05 Bihar
06 Chandigarh
07 Chhattisgarh
08 Dadra and Nagar Haveli and Daman and Diu
09 Daman and Diu
10 Goa
11 Gujarat
12 Haryana
13 Himachal Pradesh
14 Jammu and Kashmir
15 Jharkhand
16 Karnataka
17 Kerala
18 Lakshadweep
19 Madhya Pradesh
20 Maharashtra
21 Manipur
22 Meghalaya
23 Mizoram
24 Nagaland
25 New Delhi
26 Orissa
27 Puducherry
28 Punjab
29 Rajasthan
30 Sikkim
31 Tamil Nadu
32 Tripura
33 Uttar Pradesh
34 Uttarakhand
35 West Bengal
36 Telangana
37 Ladakh
77 Foreign address
""")

# Other spellings of commercial states, alias = canonical name.
STATE_ALIAS = dict(
    line.strip().split(" = ")
    for line in """
odisha = Orissa
delhi = New Delhi
pondicherry = Puducherry
uttaranchal = Uttarakhand
rajsthan = Rajasthan
rajashtan = Rajasthan
rajastan = Rajasthan
rajashthan = Rajasthan
gujrat = Gujarat
gujart = Gujarat
maharastra = Maharashtra
karnatka = Karnataka
chattisgarh = Chhattisgarh
chhatisgarh = Chhattisgarh
jharkand = Jharkhand
telengana = Telangana
telgana = Telangana
andhra = Andhra Pradesh
tamilnadu = Tamil Nadu
madhyapradesh = Madhya Pradesh
uttarpradesh = Uttar Pradesh
westbengal = West Bengal
himachal = Himachal Pradesh
dadra and nagar haveli = Dadra and Nagar Haveli and Daman and Diu
dadra & nagar haveli = Dadra and Nagar Haveli and Daman and Diu
dadra and haveli = Dadra and Nagar Haveli and Daman and Diu
dadra & haveli = Dadra and Nagar Haveli and Daman and Diu
silvassa = Dadra and Nagar Haveli and Daman and Diu
""".strip().splitlines()
)

# State code and its well-known cities.
CITIES_BY_STATE = {
    "20": "mumbai pune nagpur nashik",
    "11": "ahmedabad surat vadodara rajkot",
    "16": "bengaluru bangalore",
    "31": "chennai coimbatore",
    "35": "kolkata",
    "36": "hyderabad",
    "29": "jaipur jodhpur udaipur kota bikaner ajmer",
    "19": "indore bhopal",
    "33": "lucknow kanpur noida",
    "12": "gurgaon gurugram",
    "06": "chandigarh",
    "05": "patna",
    "15": "ranchi",
    "26": "bhubaneswar",
    "07": "raipur",
    "34": "dehradun",
    "17": "kochi",
    "02": "visakhapatnam vijayawada",
}

# Postal circles, PIN prefixes (two or three digits, ranges allowed) = state code.
# Three-digit prefixes are consulted before two-digit ones.
PIN_CIRCLES = """
744 = 01
682 = 18
737 = 30
790-792 = 03
793-794 = 22
795 = 21
796 = 23
797 = 24
799 = 32
246 248 249 262 263 = 34
403 = 10
814-816 825-829 831-835 = 15
11 = 25
12-13 = 12
14-16 = 28
17 = 13
18-19 = 14
20-28 = 33
30-34 = 29
36-39 = 11
40-44 = 20
45-48 = 19
49 = 07
50 = 36
51-53 = 02
56-59 = 16
60-64 = 31
67-69 = 17
70-74 = 35
75-77 = 26
78 = 04
80-85 = 05
"""

# States whose PINs lie inside another state's circle.
PIN_EXEMPT_STATES = ("01", "06", "08", "09", "18", "27", "37", "77")

# Consumer layout catalogues.
CONSUMER_GENDER = code_table("""
1 Male
2 Female
3 Transgender
""")
CONSUMER_ID_TYPE = code_table("""
01 PAN
02 Passport
03 Voter ID
04 Driving Licence
05 UID (Aadhaar)
06 Ration Card
07 CKYC
""")
CONSUMER_PHONE_TYPE = code_table("""
01 Mobile
02 Home
03 Office
04 Other
""")
CONSUMER_ACCOUNT_TYPE = code_table("""
01 Auto Loan
02 Housing Loan
03 Property Loan
04 Loan Against Shares
05 Personal Loan
06 Consumer Loan
07 Gold Loan
08 Education Loan
10 Credit Card
12 Commercial Vehicle Loan
13 Business Loan
51 Business Loan - Priority
52 Business Loan - General
""")
CONSUMER_OWNERSHIP = code_table("""
1 Individual
2 Authorised User
3 Guarantor
4 Joint
5 Deceased
""")
CONSUMER_STATE = code_table("""
01 Jammu and Kashmir
02 Himachal Pradesh
03 Punjab
04 Chandigarh
05 Uttarakhand
06 Haryana
07 Delhi
08 Rajasthan
09 Uttar Pradesh
10 Bihar
11 Sikkim
12 Arunachal Pradesh
13 Nagaland
14 Manipur
15 Mizoram
16 Tripura
17 Meghalaya
18 Assam
19 West Bengal
20 Jharkhand
21 Odisha
22 Chhattisgarh
23 Madhya Pradesh
24 Gujarat
25 Daman and Diu
26 Dadra and Nagar Haveli
27 Maharashtra
28 Andhra Pradesh
29 Karnataka
30 Goa
31 Lakshadweep
32 Kerala
33 Tamil Nadu
34 Puducherry
35 Andaman and Nicobar Islands
36 Telangana
37 Andhra Pradesh (New)
38 Ladakh
99 Other
""")

# Microfinance layout catalogues.
MFI_GENDER = code_table("""
F Female
M Male
T Transgender
""")
MFI_MARITAL_STATUS = code_table("""
M01 Married
M02 Separated
M03 Divorced
M04 Widowed
M05 Unmarried
M06 Untagged
""")
MFI_RELATIONSHIP = code_table("""
K01 Father
K02 Husband
K03 Mother
K04 Wife
K05 Son
K06 Daughter
K07 Brother
K08 Sister
K09 Father-in-law
K10 Mother-in-law
K11 Son-in-law
K12 Daughter-in-law
K13 Brother-in-law
K14 Sister-in-law
K15 Other
""")
MFI_RELIGION = code_table("""
R01 Hindu
R02 Muslim
R03 Christian
R04 Sikh
R05 Buddhist
R06 Jain
R07 Bahai
R08 Others
R09 Religion not stated
""")
MFI_LOAN_CATEGORY = code_table("""
T01 JLG Group
T02 JLG Individual
T03 Individual
T04 SHG Group
""")
MFI_ACCOUNT_STATUS = code_table("""
S01 Submitted/Pending
S02 Approved (not disbursed)
S03 Declined
S04 Current/Active
S05 Delinquent
S06 Written Off
S07 Closed
S08 Restructured (COVID-19)
S09 Restructured & Closed
S10 Settled
S11 Post Write Off Settled
S12 Post Write Off Closed
S15 Cancelled
""")
MFI_REPAYMENT_FREQUENCY = code_table("""
F01 Weekly
F02 Biweekly
F03 Monthly
F04 Bimonthly
F05 Quarterly
F06 Semi-annually
F07 Annually
F08 Single Payment (bullet/balloon)
F10 Other
""")
MFI_INSURANCE_TYPE = code_table("""
L01 Life
L02 Credit
L03 Health/Medical
L04 Property
L05 Liability
L10 Other
""")
MFI_ORG_STRUCTURE = code_table("""
S01 Member-based
S02 Account-based
""")
MFI_STATE = code_table("""
AP Andhra Pradesh
AR Arunachal Pradesh
AS Assam
BR Bihar
CG Chhattisgarh
GA Goa
GJ Gujarat
HR Haryana
HP Himachal Pradesh
JK Jammu & Kashmir
JH Jharkhand
KA Karnataka
KL Kerala
MP Madhya Pradesh
MH Maharashtra
MN Manipur
ML Meghalaya
MZ Mizoram
NL Nagaland
OR Odisha
PB Punjab
RJ Rajasthan
SK Sikkim
TN Tamil Nadu
TS Telangana
TR Tripura
UK Uttarakhand
UP Uttar Pradesh
WB West Bengal
AN Andaman & Nicobar
CH Chandigarh
DN Dadra & Nagar Haveli
DD Daman & Diu
DL Delhi
LD Lakshadweep
PY Puducherry
""")

# Commercial credit types.
CREDIT_TYPE = code_table("""
0100 Cash credit
0200 Overdraft
0300 Demand loan
0310 Loan extended through credit cards
0410 Medium term loan (period above 1 year and up to 3 years)
0420 Long term loan (period above 3 years)
0500 Packing credit (all export pre-shipment finance)
0610 Export bills purchased
0620 Export bills discounted
0630 Export bills advanced against
0640 Advances against export cash incentives and duty draw-back claims
0710 Inland bills purchased
0720 Inland bills discounted
0800 Advances against import bills
0900 Foreign currency cheques TCS/DDS/TTS/MTS purchased
1000 Lease finance
1100 Hire purchase
2000 Bank guarantee
2100 Deferred payment guarantee
3000 Letters of credit
3100 Corporate credit card
4000 Commercial vehicle loan
4100 Equipment financing (construction office medical)
5000 Unsecured business loan
5100 Short term loan (less than 1 year)
5200 Aggregation of all fund based facilities
5300 Aggregation of all non fund based facilities
5400 Facilities interchange between fund & non fund based
5500 Derivatives
5600 Plain vanilla forex forward contracts
5700 Plain vanila int rate swap(all including INR as coupon)
5800 Plain vanila foreign currency option (including INR cross currency)
5900 Complex int rate derv with optionalities
6000 Any complex derivative loan involving foreign currency with option
6100 Contracts on past performance - imports
6200 Contracts on past performance - exports
9000 Aggregate of all borrowings due to filing of suit
9001 Auto Loan
9002 Property Loan
9003 Gold Loan
9004 Loan Against Shares/Securities
9005 HealthCare Finance
9006 Infrastructure Finance
9007 Factoring with Recourse (Seller)
9008 Commercial Paper
9009 NCD - Non Convertible Debentures
9010 Unhedged Foreign Currency Exposure
9011 Payment Account (Point of Sale & Payment Gateways)
9012 Current Loan
9013 ARC - Secured Loan (refer Annex. B for validations)
9014 ARC - Unsecured Loan (refer Annex. B for validations)
9020 Seller Financing
9021 GECL Loan
9022 Mudra Term Loan
9023 Mudra Working Capital
9024 Temporary Overdraft
9026 Factoring without Recourse (Buyer)
9027 Overdraft against FD
9028 Overdraft against Shares / Securities
9029 Overdraft against Collateral
9030 Merchant Acquiring
9031 Government Sponsored Loan
9032 Working Capital Loan
9033 3-Wheeler Loan
9036 Credit Exposures converted to debt/equity securities due to restructuring
9999 Others
""")

CATALOGUES: dict[str, dict[str, str]] = {
    name: value
    for name, value in list(globals().items())
    if name.isupper() and isinstance(value, dict) and name not in ("STATE_ALIAS", "CITIES_BY_STATE")
}


def pin_prefix_codes() -> dict[str, str]:
    """Every postal-circle prefix spelt out: three-digit and two-digit keys to state code."""
    out: dict[str, str] = {}
    for line in PIN_CIRCLES.strip().splitlines():
        prefixes, code = line.split(" = ")
        for p in prefixes.split():
            lo, _, hi = p.partition("-")
            for n in range(int(lo), int(hi or lo) + 1):
                out[str(n)] = code
    return out


def city_codes() -> dict[str, str]:
    return {city: code for code, cities in CITIES_BY_STATE.items() for city in cities.split()}


def state_needles() -> list[tuple[str, str]]:
    """(lower-case spelling, code), longest spelling first; canonical names before aliases on ties."""
    by_name = {name: code for code, name in COMMERCIAL_STATE.items()}
    needles = [(name.lower(), code) for code, name in COMMERCIAL_STATE.items()]
    needles += [(alias, by_name[name]) for alias, name in STATE_ALIAS.items()]
    return sorted(needles, key=lambda n: -len(n[0]))
