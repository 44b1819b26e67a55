"""Word lists and tables that results depend on.  All of them are fixed values."""

# Kinds in the order in which one wins over another for the same text.
KINDS = (
    "CUSTOM NATIONAL_ID BANK_ACCOUNT BUSINESS_ID EMAIL PHONE URL INTERNAL_LINK CASE_REF BUNDLE_REF EXHIBIT_REF TRANSCRIPT_REF PROCEDURAL_REF POSTCODE ADDRESS DATE"
    " AMOUNT LOCATION BRAND CHANNEL NON_LATIN_TEXT ORG PROJECT PROJECT_OR_ISSUE DOCUMENT PERSON_OR_ORG PERSON PROPER_NOUN"
).split()
# Levels by number.
LEVELS = {1: "light", 2: "balanced", 3: "heavy"}
# Words that are no value by themselves.
FUNCTION_WORDS = "the and or of to in for with".split()
# Titles before a name.
TITLES = "Mr Ms Mrs Miss Dr Professor Prof Sir Dame Lord Lady".split()
# Given names that are also plain words.
AMBIGUOUS_NAMES = "He May Will Mark Rose Faith Hope".split()
# Names of mailboxes of a role.
ROLE_INBOXES = (
    "accounts accountspayable admin billing completion compliance contact finance hello help hr info invoice invoices legal mail noreply office operations payables"
    " privacy procurement reception sales service support team"
).split()
# Countries with account numbers of the IBAN scheme.
IBAN_COUNTRIES = (
    "AL AD AT AZ BH BY BE BA BR BG CR HR CY CZ DK DO EG SV EE FI FR GE DE GI GR GL GT HU IS IQ IE IL IT JO KZ XK KW LV LB LI LT LU LY MK MT MR MU MD MC ME MA NL NO"
    " PK PS PL PT QA RO RU SM SA RS SK SI ES SE CH TL TN TR UA AE GB VA VG"
).split()
# The alphabet and weights of the unified social credit code.
USCC_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
USCC_WEIGHTS = [1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28]
# Weights and check characters of the resident identity number.
PRC_ID_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
PRC_ID_CHECKS = "10X98765432"
# Endings of street names.
STREETS = (
    "Road Street Avenue Lane Boulevard Drive Court Place Crescent Way Terrace Parkway Trail Walk Mews Close Quay Grove Heights Circle Square Vale View Expressway"
    " Highway Gardens Fields Yard Row Rd St Ave Ln Blvd Dr Ct Pl Cres Ter Hwy Expy"
).split()
# Words before the number of a part of a building.
UNITS = "Unit Room Rm Suite Ste Flat Apartment Apt Floor Fl Level Shop Lot Studio Penthouse Basement Mezzanine".split()
# Words for buildings.
BUILDINGS = "Building Bldg Tower Towers Centre Center House Plaza Point Estate Mall Complex Block Wing Annex".split()
# Postal codes of states.
US_STATES = (
    "AL AK AZ AR CA CO CT DC DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MP MS MT NC ND NE NH NJ NM NV NY OH OK OR PA PR PW RI SC SD TN TX UT VA VI VT WA WI WV WY"
).split()
# Months.
MONTHS = "January February March April May June July August September October November December".split()
MONTHS_SHORT = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
# Endings of company names by law.
LEGAL_FORMS = (
    r"L\.?L\.?C\.?|Ltd|LTD|Limited|LIMITED|Inc|INC|Incorporated|INCORPORATED|Corp|CORP|Corporation|CORPORATION|Co\.?|CO\.?|Company|COMPANY|Partnership|PARTNERSHIP"
    r"|L\.?P\.?|L\.?L\.?P\.?|LLLP|PLLC|N\.?V\.?|B\.?V\.?|S\.?A\.?|GmbH|GMBH|AG|PLC|Pte|Pty|SARL|SDN|BHD"
)
# Softer last words of organisations' names.
ORG_TAILS = (
    "Group Holdings Partners Bank Exchange Committee University Fund Funds Capital Management Analytics Advisers Advisors Lawyers Associates"
).split()
# Last words that stand for an agency.
AGENCY_WORDS = "Administration Commission Department Agency Bureau Authority Directorate Inspectorate Office Services Council Court Tribunal".split()
# Last words of organisations, which end no person's name.
ORG_NAME_TAILS = (
    "Systems System Solutions Services Service Networks Network Airlines Airline Airways Railways Railway Logistics Freight Shipping Motors Technologies Electronics"
    " Industries Industrial Materials Chemicals Sciences Biotech Pharma Pharmaceuticals Pharmaceutical Medical Hospitals Hospital Pipeline Pipelines Energy Electric"
    " Investments Investment Partners Affiliates Markets Bank Bancorp Express Vacations Stores Brands Foods Beverages Restaurants Retail Retailers Association Council"
    " Councils Society Institute Foundation Federation University Universities Press Media Holdings Group Groups Administration Commission Department Agency Bureau"
    " Authority Directorate Inspectorate Inc Incorporated Corp Corporation LLC Ltd Limited LLP LLLP PLLC Company GmbH PLC"
).split()
# Words of no person's name.
PERSON_STOPS = (
    "Company Claimant Respondent Respondents Party Parties Tribunal Court Group Project Meeting Email Letter Report Hearing Bundle Agreement Settlement Arbitration"
    " Statements Statement Expert Enterprise Phoenix China Mainland Law Legal Rules Ordinance Companies Understanding Summary Lead Due Failure Parent Alleged Loss"
    " Damages Practice Government Subsidies Director Managing Adoption Evidence Oral Examination Memorandum Listing Application Article Civil Code Society Private"
    " International Proceedings Schedule Question Questions There This Request Requests Production Documents Timetable Procedural Financing Loans Transactions Executive"
    " Conclusions Remuneration Governance Costs Information Later Funding Management Market Deputy Chief Financial Officer Purchaser Supplier Vendor Bidder Contractor"
    " Subcontractor Procurement Buyer Not Applicable Central European Time Zone January February March April June July August September October November December"
).split()
# Phrases that no person's name holds.
PERSON_PHRASES = [
    "Arbitration No", "Table Contents", "Witness Statement", "Expert Report", "Companies Ordinance", "Listing Rules", "Memorandum of Understanding", "IPO Lead", "Due Diligence", "PRC Law",
    "Mainland China", "Civil Code", "Hong Kong", "Working Group Meeting", "Document Request Schedule", "Related-Party Transactions", "Deputy Chief Financial Officer", "Chief Operating Officer",
    "Proxy Form", "Chief Complaint", "History of Present Illness", "Past Medical History", "Past Surgical History", "Social History", "Family History", "Review of Systems", "Physical Exam",
    "Discharge Medications", "Discharge Disposition", "Discharge Diagnosis", "Hospital Course", "Emergency Department", "Operative Report", "Progress Note", "Consultation Note", "Procedure Note",
    "Plan", "Assessment", "Without Prejudice", "Subject to Contract", "Strictly Private", "Private and Confidential", "Governing Law", "Force Majeure", "Save As to Costs",
]
# Last words of headings, roles, statutes and forms, which end no person's name.
HEADING_ENDINGS = (
    "Interface Interfaces Accounts Account Module Modules Processing Automation Connection Maintenance Origination Reporting Capture Analytics Banking Manager Needed Criteria Included Support"
    " Integration System Systems Service Services Schedule Schedules Reference References Overview Summary Background Introduction Appendix Index Notes Disclosures Disclosure Methodology Findings"
    " Conclusions Acknowledgments Directors Director Representative Secretary Chairman Chairperson Chair President Officer Treasurer Auditor Registrar Proxy Signatory Act Acts Code Rules Regulation"
    " Regulations Advice Instructions Details Items Method Information Table Notice Abstract Bulletin Memorandum"
).split()
# Words that may stand before a defined term of a contract.
LEADING_WORDS = "The A An This That These Those Such Said Before First Second Third Fourth Fifth Sixth Seventh Eighth Ninth Tenth Other In Of".split()
# Words of defined terms of contracts.
CONTRACT_TERMS = (
    "Administrative Agent Agreement Amendment Annual Applicable Asset Assets Attorney Audit Base Benefit Board Business Capital Cash Certificate Change Claim Claims Class Closing Collateral"
    " Commercial Commitment Common Compensation Compliance Confidential Consideration Contract Control Convertible Corporate Credit Customer Date Debt Default Deposit Disclosure Dividend Effective"
    " Employee Employment Environmental Equity Escrow Estate Event Exchange Exercise Expense Fair Federal Fee Fees Final Financial Fiscal Forward Funds General Goods Guarantee Income Indemnity"
    " Initial Insurance Intellectual Interest Inventory Issuer Key Labor Lease Legal Lender Liability License Limited Line Loan Long Maintenance Master Material Maturity Minimum Monthly Net Notes"
    " Obligations Operating Option Options Payment Performance Permitted Personal Preferred Premises Price Principal Product Products Property Public Purchase Quarterly Rate Real Record Registered"
    " Regulatory Rent Restricted Retirement Revenue Risk Sale Sales Securities Security Senior Service Services Share Shares Shareholder Staff Stock Subsidiary Tax Taxes Term Title Trade Transaction Trust"
    " Value Vice Working"
).split()
# Cities.
CITIES = [
    "London", "New York", "Singapore", "Tokyo", "Beijing", "San Francisco", "Los Angeles", "Chicago", "Boston", "Frankfurt", "Paris", "Zurich", "Sydney", "Melbourne",
    "Toronto", "Vancouver", "Dubai", "Seoul",
]
