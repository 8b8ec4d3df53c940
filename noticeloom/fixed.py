"""Fixed values that results depend on: word lists, patterns, weights, ranks, in natural order."""

# --- Months, and the patterns of dates, times and amounts.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
LONG_DATE = r"(?i)(january|february|march|april|may|june|july|august|september|october|november|december)\.?\s+(\d{1,2}),?\s+(\d{4})"
SHORT_DATE = r"(\d{1,2})/(\d{1,2})/(\d{4})"
CLOCK_TIME = r"(?i)(\d{1,2}):(\d{2})\s?(AM|PM)"
AMOUNT = r"\$\s?([\d,]+(?:\.\d{1,2})?)"
LEAST_PRINCIPAL_CENTS = 100_000

# --- Names.
NAME_SUFFIXES = ["JR", "SR", "II", "III", "IV", "V"]
SUFFIX_ONLY = r"(?i)^(Jr\.?|Sr\.?|I{1,3}|IV|V)\z"
ENTITY_MARKERS = r"(?i)\b(LLC|L\.L\.C\.|LP|L\.P\.|LTD|CORP|CORPORATION|INC|INCORPORATED|CO\b|COMPANY|TRUST|ESTATE\s+OF|DBA|D/B/A)\b"
JOINT_MARKERS = r"(?i)\bET\s+UX\b|\bET\s+VIR\b|\bET\s+AL\b"
GENERIC_ENTITY_WORDS = [
    "TRUST", "LIVING", "REVOCABLE", "IRREVOCABLE", "FAMILY", "ESTATE", "OF", "THE", "AND", "LLC", "L.L.C", "LP", "L.P",
    "LTD", "CORP", "CORPORATION", "INC", "INCORPORATED", "CO", "COMPANY", "DBA", "D/B/A",
]
MARITAL_STATUS = r"(?i)^(?:an?\s+)?(?:unmarried|married|single)\s+(?:man|woman|person)\z|^husband\z|^wife\z|^husband and wife\z"
NAME_LIST = r"^[A-Z][a-zA-Z.&'\-]*(?:\s+[A-Z][a-zA-Z.&'\-]*){1,}"
NAME_SEPARATORS = r"(?i)\s*,\s*AND\s+|\s+AND\s+|\s+and/or\s+|,\s*"
PLACEHOLDER_BORROWERS = ["unknown owner"]

# --- Streets and subdivisions.
STREET_SUFFIXES = "ST|AVE|AV|DR|RD|LN|BLVD|CIR|CT|WAY|PL|TRL|LOOP|PKWY|HWY|EXPY|FWY"
SUBDIVISION_SUFFIX = r"(?i)\s+(?:SUBDIVISION|ADDITION|ESTATES|TOWNSITE|PARK|PLACE|HEIGHTS|ACRES|MEADOWS|VILLAGE|VILLAS?|COVES?)\z"
CITY_STATE_ZIP = r"(?i),?\s*[A-Za-z][A-Za-z .'\-]*[.,]?\s+(?:Texas|TX)\s+\d{5}\s*\z"
HOUSE_DIRECTION = r"(?i)^(\d+)\s+(?:N|S|E|W|NE|NW|SE|SW)\.?\s+(.+)\z"
GLUED_DIRECTION = r"(?i)^(\d+)(NE|NW|SE|SW|N|S|E|W)(\s+[A-Za-z])"
STREET_ADDRESS = r"(?<![\d-])\d{1,6}\s+[A-Za-z0-9.'\- ]{2,60},?\s+[A-Za-z .'\-]{2,40},?\s+(?:Texas|TX)\s+\d{5}"
COURTHOUSE_ADDRESSES = [r"(?i)2802\s+[S5§]\.?\s*Business\s+Hwy\s+281"]
OTHER_COUNTY_CITIES = (
    r"(?i)\b(?:Coppell|Dallas|Fort\s+Worth|Houston|Austin|San\s+Antonio|El\s+Paso|Plano|Irving|Frisco|Arlington|Corpus\s+Christi|Lubbock"
    r"|Laredo|Waco|Amarillo|Denton|Garland|Grand\s+Prairie|Sugar\s+Land|The\s+Woodlands|Katy|Spring)\b\s*,?\s*(?:Texas|TX)\b"
)
COUNTY_ZIP_PREFIX = "785"
OTHER_ADDRESS_CONTEXT = (
    r"(?i)located\s+at|whose\s+address|c/o|attorney\s+at\s+law|law\s+firm|\blender\b|sender\s+is|substitute\s+trustee|trustee'?s?\s+address"
    r"|servicer'?s?\s+address|mortgagee'?s?\s+address|mailing\s+address|return\s+address|business\s+address|place\s+of\s+sale"
    r"|location\s+of\s+sale|office\s+center|\bsuite\b"
)
BARCODE_NOISE = r"\d[\d.\-]{5,}\d[ \t]+\z"
META_COMMENT = r"(?i)\([^()]*\b(?:obscured|illegible|unreadable|unclear|redacted|handwrit\w*|not\s+recoverable|not\s+legible|cannot\s+be\s+read)\b[^()]*\)"
BARCODE = r"^VG-\d+-\d{4}-(\d+)\z"

# --- Labels and sentences of a notice, in the order in which they are tried.
PRINCIPAL = [
    r"(?i)Original Principal Amount:?\s*\$[\d,.]+",
    r"(?i)original(?:\s+[A-Za-z]\b)?\s+principal\s+amount\s+of\s*\$[\d,.]+",
    r"(?i)Original Principal:?\s*\$[\d,.]+",
    r"(?i)Deed of Trust Dated:?[^\n]*\n\s*Amount:?\s*\$[\d,.]+",
    r"(?i)Note\s+dated\s+[A-Za-z]+\s+\d{1,2},\s+\d{4}\s+in the amount of\s*\$[\d,.]+",
    r"(?i)Note:?\s*[\s\S]{0,120}?DOLLARS\s*\(\$[\d,.]+\)",
]
UNPAID_BALANCE = [r"(?i)unpaid balance owing on the Note is\s*\$[\d,.]+", r"(?i)unpaid balance\s*(?:owing|is|of)?\s*\$[\d,.]+"]
DEED_DATE_LABELS = [r"(?i)Deed of Trust Date:?", r"(?i)on\s+(?:[A-Za-z]+\s+\d{1,2},\s+\d{4}),?\s+[A-Z][A-Za-z .'\-]+executed a Deed of Trust"]
RECORDING_DATE_LABELS = [r"(?i)Record(?:ed|ing (?:Information|Date)):?"]
SALE_DATE_LABELS = [r"(?i)Date of Sale:?", r"(?i)Sale Information:?", r"(?im)^Date:?", r"(?i)to sell on\b"]
SALE_TIME_LABELS = [r"(?i)Time of Sale:?", r"(?im)^Time:?"]
SALE_PLACE = [r"(?i)Place of Sale:?\s*([^\n]+(?:\n[^\n]+)?)", r"(?im)^Place:?\s*([^\n]+(?:\n[^\n]+)?)"]
SALE_DATE_EVIDENCE = [r"(?i)Date of Sale:?[^\n]+", r"(?i)Sale Information:?[^\n]+", r"(?i)to sell on[^\n]+"]
INSTRUMENT = r"(?i)Instrument No\.?\s*([A-Za-z0-9\-]+)"
PROPERTY_IDS = [r"(?i)Property ID:?\s*([A-Za-z0-9\-]+)", r"(?i)Geographic ID:?\s*([A-Za-z0-9\-]+)"]
TRUSTEES = r"(?i)Substitute Trustee\(?s?\)?:?\s*([^\n]+)"
GRANTOR_LABEL = r"(?:Grant(?:o|0)r\(?s?\)?(?:/Mortgagor\(?s?\)?)?|Trustor\(?s?\)?):?"
GRANTOR_SENTENCES = [
    r"(?i)deed of trust executed by\s+([\s\S]{1,180}?)(?:\s+secures the repayment|\.\s*[Tt]he [Rr]eal property)",
    r"(?i)executed by\s+([\s\S]{1,220}?)\s*\([\"“]?(?:Mortgagor|Grantor|Trustor)\(?s?\)?[\"”]?\)",
]
GRANTOR_SAME_LINE = rf"(?i){GRANTOR_LABEL}\s*([^\n]+)"
GRANTOR_NEXT_LINE = rf"(?i){GRANTOR_LABEL}\s*\n\s*(?:[\d/]{{6,12}}\s+)?([A-Z][A-Za-z .,'\-]+(?:AND\s+[A-Z][A-Za-z .,'\-]+)?)"
OCR_NOISE = r"(?i)[0O]{1}[a-z]{2,}\d|illegible|approx, low OCR"

# --- Legal descriptions.
LEGAL_LABELS = [
    r"(?i)Legal Description:\s*([\s\S]{0,400}?)(?:\n\s*\n|Original Principal|Substitute Trustee|Date of Sale)",
    r"(?i)the property to be sold is described as follows[:.]\s*([\s\S]{0,400}?)(?:\n\s*\n|Instrument to be Foreclosed|Original Principal|Substitute Trustee|Date of Sale)",
]
LOT_SENTENCE = (
    r"(?i)(?:All of )?Lot\s+[A-Za-z0-9\-]+(?:\s*\([A-Za-z0-9]+\))?,?\s*(?:Block\s+[A-Za-z0-9\-]+(?:\s*\([A-Za-z0-9]+\))?,?\s*)?"
    r"(?:(?!\n{3}|\n\s*\d+\s*(?:\n|\z)|Date of Sale|Time of Sale|Place of [Ss]ale|Earliest time|Substitute Trustee|Original Principal)[\s\S]){0,500}"
)
SUBDIVISION_BEFORE_ADDITION = (
    r"(?i)Lots?\s+[A-Za-z0-9\-]+(?:\s*\([A-Za-z0-9]+\))?,?\s*(?:Block\s+[A-Za-z0-9\-]+(?:\s*\([A-Za-z0-9]+\))?,?\s*)?"
    r"([A-Z0-9 .'\-&]{3,80}?),\s*(?:an\s+)?addition\b"
)
SUBDIVISION_BY_WORD = r"(?i),\s*([A-Z0-9 .'\-&]{4,}(?:SUBDIVISION|SUBDIV\.?|SUBD\.?|ESTATES|ADDITION|PARK|PLAT|ACRES|HEIGHTS|MEADOWS|VILLAGE|TOWNSITE|COVES?|PLACE))\b"
LEADING_BLOCK = r"(?i)^BLOCK\s+[A-Za-z0-9\-]+\.?\s*"
ADDITION_ONLY = r"(?i)^(?:AN\s+)?ADDITION\z"
LEGAL_TOKENS = {
    "lot": r"(?i)\bLOTS?\s+([A-Z0-9()&.,\-/'\" ]+?)(?=,?\s*(?:BLOCK|BLK|OF\b|,|\z))",
    "block": r"(?i)\b(?:BLOCK|BLK)\.?\s+([0-9A-Z\-]+)",
    "section": r"(?i)\bSECTION\s+([0-9A-Z\-]+)",
    "phase": r"(?i)\bPHASE\s+([0-9A-Z\-]+)",
    "unit": r"(?i)\bUNIT\s+(?:NO\.?\s*)?([0-9A-Z\-]+)",
    "tract": r"(?i)\bTRACT\s+([0-9A-Z\-]+)",
    "survey": r"(?i)\b(?:SURVEY|SVY)\s+([0-9A-Z\-]+)",
    "abstract_number": r"(?i)\bABSTRACT\s+(?:NO\.?\s*)?([0-9A-Z\-]+)",
    "acreage": r"(?i)([0-9]+(?:\.[0-9]+)?)\s*ACRES?",
    "property_id_number": r"(?i)\b(?:PROPERTY\s+ID|PARCEL\s+(?:ID|NO)\.?|APN)\s*[:#]?\s*([0-9A-Z\-]+)",
    "geographic_id": r"(?i)\b(?:GEOGRAPHIC\s+ID|GEO\s+ID)\s*[:#]?\s*([0-9A-Z\-]+)",
    "subdivision": r"(?i)(?:,\s*)?([A-Z0-9 .'\-&]+?(?:SUBDIVISION|SUBDIV\.?|SUBD\.?|ADDITION|ESTATES|TOWNSITE|PARK|PLACE|HEIGHTS|ACRES|MEADOWS|VILLAGE|VILLA[SE]?|COVES?))\b",
}
BEFORE_LOT = r"(?i)^(.+?)\s+LOTS?\b"
TRAILING_PHASE = r"(?i)\s+(?:PH|PHASE|UT|UNIT|SEC|SECTION)\.?\s*[0-9A-Z]+\z"

# --- Lenders. Case counts in the narrative patterns.
MORTGAGEE = r"(?:[Mm]ortgagee|[Mm]origagee|[Mm]urigagee|[Mm]ortgagoe|[Mm]orgagee|[Mm]ortagee)"
CURRENT = r"(?:[Cc]urrent|[Cc]urren|[Cc]ument)"
SERVICER = r"(?:[Mm]ortgage\s+[Ss]ervicer)"
PARTY_CHARS = r"[A-Za-z0-9.,&'/\-\s]"
ENTITY_SUFFIX = r"(?:LLC|L\.L\.C\.|[Ii]nc|INC|[Cc]orp|CORP|[Cc]o|CO|[Ll]td|LTD|N\.?A\.?|PC|P\.C\.|LP|PLLC|[Bb]ank|BANK)"
PARTY_WITHIN_SENTENCE = rf"(?:[A-Za-z0-9,&'/\-\s]|\.(?!\s+[A-Z])|\.(?=\s+{ENTITY_SUFFIX}\b))"
ORIGINAL_MORTGAGEE = [
    rf"(?i)nominee\s+for\s+({PARTY_CHARS}{{1,150}}?)\s*,?\s*its\s+successors\s+and\s+assigns",
    rf"(?i)for\s+the\s+benefit\s+of\s+({PARTY_CHARS}{{1,150}}?)\s*\([\"“]?{MORTGAGEE}[\"”]?\)",
    r"(?i)Original\s+(?:Mortgagee/Beneficiary|Beneficiary/Mortgagee|Mortgagee|Beneficiary):?\s*([^\n]+)",
]
NESTED_NOMINEE = rf"(?i)nominee\s+for\s+({PARTY_CHARS}{{1,150}}?)(?:,?\s*its\s+successors\s+and\s+assigns)?\z"
CURRENT_MORTGAGEE = [
    (rf"(\b[A-Z]{PARTY_WITHIN_SENTENCE}{{1,200}}?)(?:,\s*whose address is[\s\S]{{1,150}}?)?\s+is\s+the\s+{CURRENT}\s+{MORTGAGEE}", 0.85),
    (rf"(\b[A-Z]{PARTY_WITHIN_SENTENCE}{{1,150}}?)\s+is\s+the\s+{CURRENT}\s+owner\s+and\s+holder\s+of\s+the\s+Obligations", 0.85),
    (r"(?i)Current\s+(?:Mortgagee/Beneficiary|Beneficiary/Mortgagee|Mortgagee|Beneficiary|Mortgagoe):?\s*([^\n]+)", 0.85),
    (r"(?im)^\s*(?:Lender|Payee):\s*([^\n]+)", 0.75),
    (rf"(?m)MORTGAGE ELECTRONIC REGISTRATION SYSTEMS,?\s*INC\.?\s+(\b[A-Z]{PARTY_CHARS}{{2,80}})$", 0.55),
    (rf"Current\s+(\b[A-Z]{PARTY_CHARS}{{1,80}}?)\s+Loan\s+Servicer:?", 0.55),
]
MORTGAGE_SERVICER = [
    (rf"(\b[A-Z]{PARTY_WITHIN_SENTENCE}{{1,150}}?)\s+is\s+(?:acting\s+as\s+the\s+{SERVICER}|the\s+{CURRENT}\s+mortgage\s+servicer|mortgage\s+servicer)\b", 0.85),
    (rf"(\b[A-Z]{PARTY_WITHIN_SENTENCE}{{1,150}}?),?\s+as\s+{SERVICER},?\s+is\s+representing", 0.85),
    (rf"(\b[A-Z]{PARTY_WITHIN_SENTENCE}{{1,80}}?)\s+is\s+representing\s+the\s+{CURRENT}", 0.80),
    (r"(?i)Mortgage Servicer:?\s*([^\n]+)", 0.85),
    (rf"Current\s+\b[A-Z]{PARTY_CHARS}{{1,80}}?\s+Loan\s+Servicer:?\s*~*\s*([^\n]+)", 0.55),
]
# What every match of a costly pattern has: the part after its open group.
LENDER_GUARDS = {
    "_o": [r"(?i)nominee\s+for\s", r"(?i)for\s+the\s+benefit\s+of\s", r"(?i)Original\s+(?:Mortgagee|Beneficiary)"],
    "_c": [
        rf"is\s+the\s+{CURRENT}\s+{MORTGAGEE}", rf"is\s+the\s+{CURRENT}\s+owner\s+and\s+holder", r"(?i)Current\s+(?:Mortgag|Beneficiary)", r"(?i)(?:Lender|Payee):",
        r"MORTGAGE ELECTRONIC REGISTRATION SYSTEMS", r"Loan\s+Servicer",
    ],
    "_s": [rf"is\s+(?:acting\s+as\s+the\s+{SERVICER}|the\s+{CURRENT}\s+mortgage\s+servicer|mortgage\s+servicer)", rf"as\s+{SERVICER},?\s+is\s+representing", rf"is\s+representing\s+the\s+{CURRENT}", r"(?i)Mortgage Servicer", r"Loan\s+Servicer"],
}
NOT_A_PARTY = [
    r"(?i)^(?:Original|Current)\s+(?:Mortgagee|Beneficiary)",
    r"(?i)^(?:Mortgagee|Beneficiary|Lender|Servicer|Trustee)s?\z",
    r"(?i)^(?:MORTGAGE SERVICING INFORMATION|TERMS OF SALE|SALE INFORMATION|NOTICE OF (?:SUBSTITUTE )?TRUSTEE'?S SALE|INSTRUMENT BEING FORECLOSED)\z",
    r"(?i)^Information\b",
    r"(?i)substitute trustee|auction\.com|title services|posting and publishing",
    r"^\d{1,6}\s",
    r"(?i)\bto\b",
    r"(?i)\bis\s+the\b",
    rf"[a-z]{{3,}}\.\s+(?!{ENTITY_SUFFIX}\b)[A-Z]",
    r"(?i)\bMortgage\s+Servicer\b",
]

# --- Confidences of extracted fields.
CONFIDENCE = {
    "borrower_names": 0.90, "grantor_names": 0.90, "original_principal": 0.92, "current_balance": 0.85, "deed_date": 0.90, "instrument_number": 0.90,
    "recording_date": 0.85, "property_address": 0.95, "legal_description": 0.88, "property_id": 0.80, "sale_date": 0.95, "sale_time": 0.90,
    "sale_location": 0.85, "substitute_trustee": 0.85, "original_mortgagee": 0.85,
}
WEAK_FIELD, LOW_OVERALL = 0.6, 0.55
OCR_TRUST, OCR_LEAST_CHARS, SHORT_TEXT, LONG_SPAN = 70.0, 100, 200, 20

# --- Matching a case with appraisal records.
MATCH_WEIGHTS = {
    "parcel_id": 0.6, "geographic_id": 0.55, "subdivision_lot": 0.5, "subdivision": 0.2, "legal_text": 0.2, "owner": 0.15, "acreage": 0.1, "city": 0.05,
    "mailing": 0.03, "owner_conflict": -0.3, "lot_block_conflict": -0.5, "acreage_conflict": -0.15,
}
MATCH_FLOORS = {"parcelId": 0.99, "geographicId": 0.97, "subdivision+lot": 0.97, "legalDescriptionTokens": 0.94, "ownerName+": 0.88, "ownerName": 0.65}
ACCEPT, REVIEW, MARGIN = 0.92, 0.70, 0.15
SAME_ACREAGE, OTHER_ACREAGE = 0.05, 0.5
STATED_CONFIDENCE = {"EXPLICIT_STATED": 0.98, "COMMONLY_KNOWN_AS_PHRASE": 0.90}
RESOLUTION_METHODS = {
    "explicit_address": "EXPLICIT_STATED", "parcel_id_match": "PROPERTY_ID_MATCH", "geographic_id_match": "GEOGRAPHIC_ID_MATCH",
    "exact_legal_description": "LEGAL_DESCRIPTION_MATCH", "subdivision_lot_block": "LEGAL_DESCRIPTION_MATCH", "multi_field_match": "MULTI_FIELD_MATCH",
    "manual": "OWNER_MAILING_ADDRESS_MATCH", "unresolved": "UNRESOLVED",
}

# --- Duplicate events.
DUPLICATE_WEIGHTS = {
    "trusteeSaleTrackingNumber": 0.5, "rawTextFingerprint": 0.45, "propertyAddress": 0.25, "legalDescription": 0.2, "borrowerNames": 0.15,
    "originalPrincipalAmount": 0.15, "deedOfTrustDate": 0.1, "saleDate": 0.08, "lenderName": 0.08,
}
DUPLICATE_CONFLICTS = {"propertyAddress": -0.6, "legalDescription": -0.6, "saleDate": -0.1, "originalPrincipalAmount": -0.15, "lenderName": -0.1, "borrowerNames": -0.2}
LOAN_FIELDS = ["originalPrincipalAmount", "deedOfTrustDate", "lenderName"]
SAME_TEXT, LIKELY_FIELDS, POSSIBLE_FIELDS = 0.9, 4, 2
TRACKING_NUMBER = r"\b(\d{4}-\d{4,6}-[A-Z]{1,4})\b"

# --- Canonical case of a group.
METHOD_RANKS = {
    "EXPLICIT_STATED": 10, "MULTI_FIELD_MATCH": 9, "PROPERTY_ID_MATCH": 8, "GEOGRAPHIC_ID_MATCH": 8, "LEGAL_DESCRIPTION_MATCH": 7, "CACHED_MATCH_REUSE": 6,
    "COMMONLY_KNOWN_AS_PHRASE": 6, "MANUAL": 5, "OWNER_MAILING_ADDRESS_MATCH": 4, "GEOCODING": 3, "UNRESOLVED": 0,
}
TIE = 0.01

# --- Publication.
CRITICAL_REASONS = ["CAD_OWNER_CONFLICT", "BORROWER_NAME_CONFLICT", "SALE_DATE_CONFLICT", "MISSING_FILING_NUMBER", "POSSIBLE_CONTENT_DUPLICATE", "POOR_TEXT_QUALITY"]
ADDRESS_TRUST = 0.7
PUBLIC = ["PUBLISHED", "PUBLISHED_WITH_LIMITED_DATA"]

# --- Triage of review tasks: buckets by rank, and the reasons that lead to them.
TRIAGE_ORDER = ["MEANINGFUL_REVIEW", "MISSING_DATA", "QUICK_APPROVAL", "NON_BLOCKING_ENRICHMENT"]
CONFLICT_REASONS = ["CAD_OWNER_CONFLICT", "BORROWER_NAME_CONFLICT", "SALE_DATE_CONFLICT", "POSSIBLE_CONTENT_DUPLICATE"]
GAP_REASONS = ["POOR_TEXT_QUALITY", "MISSING_FILING_NUMBER"]

# --- Accounts.
GOOD_STANDING = ["ACTIVE", "TRIALING", "PROMOTIONAL"]
PAYMENT_LATE = ["PAST_DUE", "PAYMENT_FAILED"]
PLANS = ["FREE", "COUNTY", "UNLIMITED"]

# --- Whose address a notice states: roles in the order in which they are tried.
ADDRESS_ROLES = {
    "TRUSTEE OFFICE": [r"(?i)substitute trustee'?s?\s+address", r"(?i)trustee'?s?\s+address", r"(?is)trustee:.{0,80}address"],
    "LENDER/MORTGAGEE OFFICE": [r"(?i)lender'?s?\s+address", r"(?i)mortgagee'?s?\s+address", r"(?i)beneficiary'?s?\s+address", r"(?i)servicer'?s?\s+address"],
    "COURTHOUSE": [r"(?i)county courthouse", r"(?i)317 n\.?\s*closner", r"(?i)courthouse door"],
    "LAW FIRM": [r"(?i)attorney at law", r"(?i)law firm", r"(?i)law office", r"(?i),\s*p\.?c\.?\b", r"(?i),\s*l\.?l\.?p\.?\b"],
    "MAILING/RETURN ADDRESS": [r"(?i)return to:", r"(?i)after recording,?\s*return to", r"(?i)return address", r"(?i)prepared by"],
}
ROLE_BEFORE, ROLE_AFTER, ROLE_HEAD = 200, 50, 2000

# --- Legacy rows against ingested ones.
SAME_EVENT_FIELDS, SAME_NAMES = 3, 0.6

# --- Reasons of gap-fill changes.
GAP_REASON = {
    "placeholder": "Gap: old value was null/placeholder.",
    "null": "Gap: old value was null.",
    "legal": "Gap: no LegalDescription row existed.",
    "sale": "Gap: no ForeclosureSale row existed.",
    "name_cut": "Truncation repair: old value is a prefix of the corrected value (real line-wrap defect).",
    "legal_cut": "Truncation repair: old value is a prefix of the corrected value (real character-budget defect).",
}

# --- Sentences on decisions; {} are the parts that differ.
EXPLANATIONS = {
    "parcel_id_match": "Exact parcel ID match to the county appraisal record{uniqueness}.",
    "geographic_id_match": "Exact geographic ID match to the county appraisal record{uniqueness}.",
    "subdivision_lot_block": "Subdivision, lot, and block matched the county appraisal record (matched fields: {fields}){uniqueness}.",
    "exact_legal_description": "Legal description text matched the county appraisal record's legal description{uniqueness}.",
    "multi_field_match": "Multiple corroborating fields matched the county appraisal record ({fields}){uniqueness}.",
    "manual": "Matched on: {fields}{uniqueness}.",
}
UNIQUENESS = " (best of {n} candidates considered)"
REVIEW_EXPLANATIONS = {
    "owner": "The top candidate scored {score} but the county record's current owner conflicts with the foreclosure's borrower/grantor — never auto-accepted regardless of score, sent to manual review.",
    "conflict": "The top candidate scored {score} but has a conflicting {conflicts} — sent to manual review rather than auto-accepted.",
    "owner_alone": "The top candidate matched on owner name only (score {score}) — owner name alone is never sufficient to auto-publish, sent to manual review.",
    "close": "The top candidate scored {score}, only {margin} ahead of the next candidate ({second}) — sent to manual review.",
    "below": "The top candidate scored {score}, below the auto-accept threshold — sent to manual review.",
    "nothing": "No candidate scored above the manual-review threshold (best was {score}).",
    "none": "No appraisal-district candidates were found for the available fields (legal description / owner name / parcel / geographic ID).",
}

# --- Loans and values.
ANNUAL_RATE_PCT, TERM_YEARS, DAYS_A_MONTH = 6.5, 30, 30.44
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 0.85, 0.6
EQUITY_LOW_CENTS, EQUITY_HIGH_CENTS = 2_500_000, 7_500_000

# --- What readers see where a value is unknown, or not theirs to see.
NO_EQUITY, NO_MONEY, NO_SALE_DATE = "Estimated equity unavailable", "Not available", "Sale date unavailable"
NO_OWNER, NO_PRINCIPAL, NO_COUNTY_VALUE = "Owner unavailable", "Original loan amount unavailable", "County value unavailable"
ADDRESS_LOCKED, ADDRESS_PENDING = "Address available with paid plan", "Address not yet available"
