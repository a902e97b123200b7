"""Dimension values and their DataFrames. All are constants of fixed size, safe to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Canonical segment -> raw product labels.
SEGMENTS: dict[str, tuple[str, ...]] = {
    "credit_reporting": (
        "Credit reporting",
        "Credit reporting, credit repair services, or other personal consumer reports",
        "Credit reporting or other personal consumer reports",
    ),
    "debt_collection": ("Debt collection",),
    "debt_relief": ("Debt or credit management",),
    "mortgage": ("Mortgage",),
    "card": ("Credit card", "Credit card or prepaid card", "Prepaid card"),
    "bank_account": ("Bank account or service", "Checking or savings account"),
    "student_loan": ("Student loan",),
    "consumer_loan": (
        "Consumer Loan",
        "Vehicle loan or lease",
        "Payday loan, title loan, personal loan, or advance loan",
        "Payday loan, title loan, or personal loan",
        "Payday loan",
    ),
    "money_transfer": ("Money transfer, virtual currency, or money service", "Money transfers", "Virtual currency"),
    "other_financial_service": ("Other financial service",),
}
SELECTED = ("credit_reporting", "debt_collection", "mortgage", "card", "student_loan", "consumer_loan")
CONTROLS = ("mortgage", "bank_account", "money_transfer")

# Legal forms stripped from the end of a company name.
LEGAL_FORMS = (
    "INC", "INCORPORATED", "LLC", "L L C", "LLP", "LP", "PLC", "PC", "PA", "CORP", "CORPORATION", "CO", "COMPANY", "NA", "N A", "FSB", "FA", "SB",
    "SSB", "LTD", "LIMITED", "SA", "AG", "NV", "TRUST", "BANK NA",
)

# Normalised company name -> corporate group.
ALIASES: dict[str, str] = {
    "LEXISNEXIS": "LexisNexis",
    "LEXISNEXIS RISK SOLUTIONS": "LexisNexis",
    "RESURGENT CAPITAL SERVICES L P": "Resurgent Capital Services",
    "RESURGENT CAPITAL SERVICES": "Resurgent Capital Services",
    "CBC COMPANIES": "CBC Companies",
    "EQUIFAX": "Equifax",
    "EQUIFAX INFORMATION SERVICES": "Equifax",
    "EXPERIAN": "Experian",
    "EXPERIAN INFORMATION SOLUTIONS": "Experian",
    "TRANSUNION": "TransUnion",
    "TRANS UNION": "TransUnion",
    "TRANSUNION INTERMEDIATE HOLDINGS": "TransUnion",
    "NAVIENT SOLUTIONS": "Navient",
    "NAVIENT": "Navient",
    "SALLIE MAE": "Sallie Mae",
    "SLM": "Sallie Mae",
    "AIDVANTAGE": "Maximus/Aidvantage",
    "MAXIMUS FEDERAL SERVICES": "Maximus/Aidvantage",
    "MOHELA": "MOHELA",
    "MISSOURI HIGHER EDUCATION LOAN AUTHORITY": "MOHELA",
    "NELNET": "Nelnet",
    "GREAT LAKES EDUCATIONAL LOAN SERVICES": "Nelnet",
    "FEDLOAN SERVICING": "PHEAA/FedLoan",
    "PHEAA": "PHEAA/FedLoan",
    "AES PHEAA": "PHEAA/FedLoan",
    "AES": "PHEAA/FedLoan",
    "AMERICAN EDUCATION SERVICES": "PHEAA/FedLoan",
    "PENNSYLVANIA HIGHER EDUCATION ASSISTANCE AGENCY": "PHEAA/FedLoan",
    "EDFINANCIAL SERVICES": "EdFinancial",
    "NATIONSTAR MORTGAGE": "Mr. Cooper",
    "MR COOPER": "Mr. Cooper",
    "MR COOPER GROUP": "Mr. Cooper",
    "OCWEN LOAN SERVICING": "Ocwen/PHH",
    "OCWEN FINANCIAL": "Ocwen/PHH",
    "PHH MORTGAGE": "Ocwen/PHH",
    "PORTFOLIO RECOVERY ASSOCIATES": "PRA Group",
    "PRA GROUP": "PRA Group",
    "MIDLAND CREDIT MANAGEMENT": "Encore Capital",
    "MIDLAND FUNDING": "Encore Capital",
    "ENCORE CAPITAL GROUP": "Encore Capital",
    "JPMORGAN CHASE AND": "JPMorgan Chase",
    "JPMORGAN CHASE": "JPMorgan Chase",
    "CHASE": "JPMorgan Chase",
    "BANK OF AMERICA": "Bank of America",
    "WELLS FARGO AND": "Wells Fargo",
    "WELLS FARGO": "Wells Fargo",
    "CITIBANK": "Citigroup",
    "CITIGROUP": "Citigroup",
    "CAPITAL ONE": "Capital One",
    "CAPITAL ONE FINANCIAL": "Capital One",
    "SYNCHRONY": "Synchrony",
    "SYNCHRONY BANK": "Synchrony",
    "SYNCHRONY FINANCIAL": "Synchrony",
    "EQUIFAX INFORMATION SERVICES LL": "Equifax",
}

# Dated events of corporate groups.
CORPORATE_EVENTS = (
    ("Maximus/Aidvantage", "2021-10-20", "takes over Navient's federal servicing contract (2.7M borrowers)"),
    ("Navient", "2017-01-18", "CFPB sues Navient for failing borrowers at every stage of repayment"),
    ("Navient", "2021-12-31", "stops servicing Direct Loans for the Dept of Education"),
    ("Navient", "2024-09-12", "CFPB bans Navient from federal student loan servicing and orders $120M in penalties and redress"),
    ("Navient", "2024-10-21", "remaining portfolio transfers to MOHELA"),
    ("PHEAA/FedLoan", "2022-06-27", "exits federal servicing; 8.5M loans transfer out through 2022"),
    ("MOHELA", "2022-06-27", "receives FedLoan/PHEAA transfer volume"),
    ("MOHELA", "2024-10-21", "receives Navient's remaining portfolio"),
    ("EdFinancial", "2022-06-27", "receives FedLoan/PHEAA transfer volume"),
    ("Nelnet", "2022-06-27", "receives FedLoan/PHEAA transfer volume"),
)
# Dates whose effect is tested, in the order that breaks ties.
MILESTONES = (("chatgpt_public_launch", "2022-11-30"), ("gpt4_release", "2023-03-14"), ("chatgpt_mass_adoption", "2023-01-31"))
# Policy and market events by segment.
CONFOUNDERS = (
    ("student_loan", "2020-03-13", "CARES Act payment pause and interest waiver begin (retroactive to this date)"),
    ("student_loan", "2021-10-20", "Navient federal servicing contract taken over by Maximus/Aidvantage"),
    ("student_loan", "2022-06-27", "FedLoan/PHEAA exits servicing; 8.5M loans transfer to MOHELA, Nelnet, EdFinancial and Navient through 2022"),
    ("student_loan", "2022-08-24", "Biden administration announces broad loan forgiveness"),
    ("student_loan", "2023-06-30", "Supreme Court decides Biden v. Nebraska, striking down the forgiveness program"),
    ("student_loan", "2023-09-01", "interest resumes on federal student loans"),
    ("student_loan", "2023-10-01", "federal student loan payments resume; 12-month credit-reporting on-ramp begins"),
    ("student_loan", "2024-09-30", "on-ramp ends; delinquencies again reported to credit bureaus"),
    ("student_loan", "2024-10-21", "MOHELA takes over Navient's remaining portfolio"),
    ("credit_reporting", "2022-07-01", "big three remove paid medical collections; unpaid medical debt reporting delayed from 6 months to 1 year"),
    ("credit_reporting", "2023-04-11", "big three remove medical collections under $500, roughly 70% of medical collection tradelines"),
    ("debt_collection", "2021-11-30", "CFPB Regulation F debt collection rule takes effect"),
    ("mortgage", "2020-03-27", "CARES Act mortgage forbearance provisions enacted"),
)
# Codes in the state field that have no population.
NON_STATES = ("PR", "VI", "GU", "AS", "MP", "AA", "AE", "AP", "FM", "MH", "PW", "UM", "")
# Outcomes.
MONETARY, NON_MONETARY, EXPLANATION = "Closed with monetary relief", "Closed with non-monetary relief", "Closed with explanation"
RELIEF = (MONETARY, NON_MONETARY)
NON_FINAL = ("In progress", "")


def segment_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(raw, seg) for seg, raws in SEGMENTS.items() for raw in raws], "label string, segment string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES.items()), "key string, grp string")


def dated(spark: SparkSession, rows, key: str) -> DataFrame:
    """(key, event_date, description) of (key, ISO date, description) rows."""
    return spark.createDataFrame([tuple(r) for r in rows], f"{key} string, event_date string, description string").selectExpr(key, "to_date(event_date) as event_date", "description")


def milestones(spark: SparkSession, rows=MILESTONES) -> DataFrame:
    return spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(rows)], "ord int, name string, event_date string").selectExpr("ord", "name", "to_date(event_date) as event_date")
