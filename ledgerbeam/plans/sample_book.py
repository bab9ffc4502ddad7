"""A loan book derived from the driver's star-schema tables, as Master-Sheet rows and as segment sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.partitioning import deal_out

CITY = "element_at(array('Mumbai','Pune','Jaipur','Kochi','Hyderabad','Patna','Surat'), cast({0} % 7 + 1 as int))"
STATE = ("element_at(array('Maharashtra','Maharashtra','Rajasthan','Kerala','Telangana','Bihar','Gujarat'), "
         "cast({0} % 7 + 1 as int))")
MISSPELT = ("element_at(array('Maharashtraa','Maharashtraa','Rajasthaan','Keralaa','Telanganna','Biharr','Gujarath'), "
            "cast({0} % 7 + 1 as int))")
PIN = ("element_at(array('400','411','302','682','500','800','395'), cast({0} % 7 + 1 as int)) || "
       "lpad(cast({0} % 1000 as string), 3, '0')")
PAN = ("'AAA' || substr('CPFTH', cast({0} % 5 + 1 as int), 1) || chr(65 + {0} % 26) || "
       "lpad(cast({0} % 10000 as string), 4, '0') || chr(65 + {0} % 7)")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """One row per borrower with raw sheet texts."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
    c = c.selectExpr("concat('S', n_regionkey) as submission_id", "c_custkey as k", "c_name", "c_mktsegment", "c_acctbal")
    city, state, pin = CITY.format("k"), STATE.format("k"), PIN.format("k")
    address = f"""case
        when k % 53 = 2 then 'Unit 7, Unknown Place'
        when k % 6 = 0 then concat('Plot ', k, ', Area ', k % 97, ', ', {city}, ', ', {state}, ' ', {pin})
        when k % 6 = 1 then concat('Plot No-1', lpad(k, 6, '0'), ', Area ', k % 97, ', ', {city}, ', ', {state}, '-', {pin})
        when k % 6 = 2 then concat('Unit ', k, ', Area ', k % 97, ', ', {city}, ' - ', {pin}, '. INDIA')
        when k % 6 = 3 then concat('House ', k, ', Area ', k % 97, ', ', {city}, ', ', {MISSPELT.format("k")}, ' ', {pin})
        when k % 6 = 4 then 'NA'
        else concat('Flat ', k, ',\\nArea ', k % 97, ',\\r\\n', {city}, ', ', {state}, ' India ', {pin}) end"""
    return c.selectExpr(
        "submission_id", "k", "c_mktsegment", "c_acctbal",
        "case when k % 41 = 0 and submission_id = 'S3' then concat(c_name, ' | Sons') when k % 43 = 1 then '' else c_name end as borrowerName",
        f"case when k % 37 = 0 then lower({PAN.format('k')}) else {PAN.format('k')} end as pan",
        """case c_mktsegment when 'HOUSEHOLD' then 'Proprietorship' when 'FURNITURE' then '2' when 'MACHINERY' then 'Pvt  Ltd'
           when 'BUILDING' then '40' else 'Cooperative Club' end as legalConstitution""",
        "case k % 4 when 0 then 'MSME' when 1 then '5' when 2 then ' Small ' end as businessCategory",
        "case k % 3 when 0 then 'Manufacture' when 1 then '6' else '6. Service Provider' end as businessIndustryType",
        f"{address} as address",
        """case k % 3 when 0 then concat('9', lpad(k, 9, '0')) when 1 then concat('040', lpad(k, 8, '0'))
           else concat('+91 98', lpad(k, 8, '0')) end as contactNo""",
        "case when k % 2 = 0 then concat('Person ', k) end as relatedName",
        "case k % 4 when 0 then 'Male' when 2 then '02' end as relatedGender",
        "case when k % 2 = 0 then '01/01/1970' end as relatedDob",
        f"case when k % 2 = 0 then {PAN.format('(k + 1)')} end as relatedPan",
        f"case when k % 2 = 0 then concat('Plot ', k, ', Area ', k % 97, ', ', {city}, ', ', {state}, ' ', {pin}) end as relatedAddress",
        "case k % 4 when 0 then 'Promoter Director' when 2 then '12' end as relationshipType",
    )


def dealt_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Borrowers dealt over all tasks: their file is small, so a scan of it has few splits, whatever the work on each row."""
    return deal_out(customers(spark, sf), "k")


def guarantor_columns(spark: SparkSession, sf: str) -> DataFrame:
    """An array of guarantors per order, one from the supplier of each of its lines."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("l_suppkey"))
    s = li.join(table(spark, sf, "supplier").select("s_suppkey", "s_name"), F.expr("l_suppkey = s_suppkey"))
    return s.groupBy(F.col("l_orderkey").alias("row_no")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "s_name"))).alias("lines"))  # the lines of one order


def loans(spark: SparkSession, sf: str) -> DataFrame:
    """One Master-Sheet row per order: account inputs joined to the borrower's."""
    o = table(spark, sf, "orders").selectExpr(
        "o_custkey as k", "o_orderkey as row_no", "o_orderpriority", "o_orderstatus", "o_totalprice", "cast(o_orderdate as date) as d")
    acct = o.selectExpr(
        "k", "row_no",
        "case when row_no % 29 = 0 then concat('C', k) else cast(row_no as string) end as accountNumber",
        """case when row_no % 47 = 0 then 'soon' when row_no % 4 = 0 then date_format(d, 'dd/MM/yyyy')
           when row_no % 4 = 1 then date_format(d, 'ddMMyyyy') when row_no % 4 = 2 then date_format(d, 'd-M-yyyy')
           else date_format(d, 'dd MMMM yyyy') end as sanctionDate""",
        """case when row_no % 11 = 0 then 'NA' when row_no % 13 = 0 then concat(cast(floor(o_totalprice) as bigint), '.5')
           else cast(cast(round(o_totalprice * 100) as bigint) as string) end as sanctionedAmount""",
        """case when row_no % 19 = 0 then 'Mystery loan' when row_no % 4 = 0 then '0300' when row_no % 4 = 1 then 'Overdraft'
           when row_no % 4 = 2 then 'gold  loan' else '9032' end as creditType""",
        """case o_orderpriority when '1-URGENT' then 'Monthly' when '2-HIGH' then '2' when '3-MEDIUM' then 'Half-yearly'
           when '4-NOT SPECIFIED' then 'Whenever' else '05' end as repaymentFrequency""",
        "cast(cast(floor(o_totalprice) as bigint) as string) as currentBalance",
        """case when row_no % 23 = 0 then null when row_no % 5 = 0 then 'Standard' when row_no % 5 = 1 then '0002'
           when row_no % 5 = 2 then 'SMA 1' when row_no % 5 = 3 then '10' else 'Doubtful - 2' end as assetClassification""",
        "case o_orderstatus when 'F' then 'Closed' when 'O' then 'Open' else '4' end as accountStatus",
        "case when row_no % 31 = 0 then 'Yes' else 'No' end as wilfulDefault",
        "case when row_no % 62 = 0 then '01/02/2020' end as wilfulDefaultDate",
        "case row_no % 6 when 0 then 'Warehouse' when 1 then '02' end as locationType",
        "case row_no % 8 when 0 then '100000' when 1 then '0' end as securityValue",
        "case row_no % 8 when 0 then 'Land' when 1 then 'NA' end as securityType",
        "case row_no % 8 when 0 then 'Primary - First Charge' when 1 then 'NA' end as securityClass",
        "date_format(d, 'ddMMyyyy') as order_day",
    )
    return deal_out(acct.join(customers(spark, sf), "k"), "row_no")


def master_book(spark: SparkSession, sf: str) -> DataFrame:
    """Loans with their guarantor blocks."""
    book = loans(spark, sf).join(guarantor_columns(spark, sf), "row_no", "left")

    s = "g.l_suppkey"
    address = f"concat('Shop ', {s}, ', ', {CITY.format(s)}, ', ', {STATE.format(s)}, ' ', {PIN.format(s)})"
    blocks = F.expr(f"""transform(lines, g -> named_struct(
        'type', case when {s} % 2 = 0 then 'Individual' else '1' end,
        'entityName', case when {s} % 2 = 1 then g.s_name end, 'fullName', case when {s} % 2 = 0 then g.s_name end,
        'dob', case when {s} % 2 = 0 then '02/01/1970' end, 'pan', case when row_no % 3 = 0 then relatedPan end,
        'gender', case when {s} % 2 = 0 then 'Female' end, 'addressLine1', cast(null as string),
        'addressLine2', cast(null as string), 'addressLine3', cast(null as string), 'address', {address},
        'city', cast(null as string), 'district', cast(null as string), 'state', cast(null as string),
        'pin', cast(null as string), 'mobile', cast(null as string), 'stdCode', cast(null as string),
        'landline', cast(null as string), 'contact', cast(null as string)))""")
    return deal_out(book.withColumn("guarantors", blocks).drop("lines"), "row_no")


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Run parameters, one row per region."""
    return table(spark, sf, "region").selectExpr(
        "concat('S', r_regionkey) as submission_id", "concat('MBR', lpad(r_regionkey, 7, '0')) as member_id",
        "concat('Lender ', r_name) as member_name", "upper(substr(r_name, 1, 10)) as member_short_name",
        "date_add(date'2026-07-09', cast(r_regionkey * 7 as int)) as reporting_date",
        "date_add(date'2026-08-01', cast(r_regionkey as int)) as creation_date",
        "concat('pw', r_regionkey) as password",
        "map('cycle_id', lpad(r_regionkey, 2, '0'), 'org_structure', 'S01') as extras")


def borrower_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """BS segment sheet; every 17th borrower is typed twice."""
    return dealt_customers(spark, sf).selectExpr(
        "submission_id", "concat('B', k) as ac_no", "explode(case when k % 17 = 0 then array(k * 2, k * 2 + 1) else array(k * 2) end) as row_no",
        "borrowerName", "upper(pan) as pan", "'11' as legalConstitution")


def address_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """AS segment sheet; some borrowers have no registered office."""
    return dealt_customers(spark, sf).selectExpr(
        "submission_id", "concat('B', k) as ac_no", "k as row_no",
        "case when k % 10 = 3 then '03' when k % 10 = 4 then null else '01' end as officeLocationType",
        "concat('Plot ', k) as addressLine1", f"{CITY.format('k')} as cityTown", f"{PIN.format('k')} as pinCode",
        "case when k % 21 = 0 then '12' else contactNo end as mobileNumber")


def facility_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """CR segment sheet."""
    return loans(spark, sf).selectExpr(
        "submission_id", "concat('B', k) as ac_no", "row_no", "accountNumber",
        "case when row_no % 47 = 0 then 'soon' else order_day end as sanctionDate",
        "nullif(sanctionedAmount, 'NA') as sanctionedAmount",
        "case row_no % 9 when 0 then 'JPY' when 1 then null else 'USD' end as currencyCode",
        "case when row_no % 23 = 0 then null else '0001' end as assetClassification",
        "case when wilfulDefault = 'Yes' then '1' else '0' end as wilfulDefaultStatus",
        "case when row_no % 62 = 0 then '01022020' end as wilfulDefaultDate")


def consumer_form(spark: SparkSession, sf: str) -> DataFrame:
    """Consumer form rows, one per order."""
    return loans(spark, sf).selectExpr(
        "submission_id", "row_no",
        "case k % 3 when 0 then concat('Asha  Rao Devi K', k) when 1 then concat('Meera N', k) else concat('Lakshmi', k) end as consumerName",
        "case when k % 19 = 0 then '1 Jan 1980' else '05/06/1980' end as dateOfBirth", "cast(k % 4 + 1 as string) as gender",
        "case when k % 5 > 0 then upper(pan) end as pan", "case when k % 3 = 0 then contactNo end as mobile",
        "case when k % 7 = 0 then concat('u', k, '@example.org') end as email",
        "concat('Plot ', k, ' Long Winding Road behind the Old Water Tower in Ward ', k % 97, ' near the Municipal School Building Block ', k % 9) as address",
        "'27' as stateCode", f"{PIN.format('k')} as pinCode", "case when k % 2 = 0 then '02' end as addressCategory",
        "cast(null as string) as residenceCode", "'RAW1' as memberCode", "cast(null as string) as memberShortName",
        "accountNumber", "'05' as accountType", "cast(null as string) as ownershipIndicator", "order_day as dateOpened",
        "cast(null as string) as dateLastPayment", "'31072026' as dateReported", "nullif(sanctionedAmount, 'NA') as highCredit",
        "currentBalance", "case row_no % 3 when 0 then '0' when 1 then '250' end as amountOverdue",
        "cast(row_no % 90 as string) as daysPastDue", "case when row_no % 21 > 0 then '00' end as suitFiled",
        "case when row_no % 2 = 0 then '02' end as assetClassification", "case when row_no % 22 > 0 then '12.50' end as rateOfInterest",
        "'36' as repaymentTenure")


def mfi_sheets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Microfinance segment sheets: member, address, account."""
    c = dealt_customers(spark, sf)
    member = c.selectExpr(
        "submission_id", "concat('M', k) as ac_no", "k as row_no", "concat('MEM', k) as memberIdentifier", "'BR1' as branchIdentifier",
        "concat('K', k % 12) as kendraIdentifier", "borrowerName as memberName1", "'05061980' as birthDate", "cast(20 + k % 50 as string) as age",
        "'45.50' as ageAsOnDate", "element_at(array('F','M','X'), cast(k % 3 + 1 as int)) as gender", "'M01' as maritalStatus",
        "'Key Person' as keyPersonName", "case when k % 8 = 0 then 'K99' else 'K02' end as keyPersonRelationship", "upper(pan) as pan")
    address = c.selectExpr(
        "submission_id", "concat('M', k) as ac_no", "k as row_no", "concat('Plot ', k) as permanentAddress", "'MH' as permanentState",
        f"{PIN.format('k')} as permanentPin", "concat('Plot ', k) as currentAddress", "case when k % 9 = 0 then 'ZZ' else 'MH' end as currentState",
        f"{PIN.format('k')} as currentPin")
    account = loans(spark, sf).selectExpr(
        "submission_id", "concat('M', k) as ac_no", "row_no", "concat('U', row_no) as uniqueAccountRef", "accountNumber", "'BR1' as actBranchIdentifier",
        "concat('K', k % 12) as actKendraIdentifier", "'31072026' as dateOfAccountInfo", "'T01' as loanCategory", "'Farm' as loanPurpose",
        "'S04' as accountStatus", "add_months(to_date(order_day, 'ddMMyyyy'), 288) as disbursedDate",
        "currentBalance as sanctionedAmount", "currentBalance as disbursedAmount",
        "case when row_no % 3 = 0 then null else '12' end as numInstallments", "case when row_no % 4 = 0 then null else 'F03' end as repaymentFrequency",
        "'500' as installmentAmount", "currentBalance", "'0' as amountOverdue")
    return member, address, account
