"""Patterns, word lists and lookup tables that define what counts as a match.

Results are only right when these equal the published ones, so they are stated as plain text.
Patterns are in their published dialect; ``functions.strings.to_java`` turns them into the
form Spark's regex functions need. Everything here is small and constant, so it is inlined
into plans as literals and never broadcast.
"""

import re

# White space as the snippet gate strips it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
MAX_SNIPPET_CHARS = 200
USABLE = re.compile("[A-Za-z0-9]")

# Free-standing patterns.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE_FREE = (
    r"(?<!\w)(?:\+\d{1,3}[\s.\-/]?)?(?:\(?\d{2,5}\)?[\s.\-/]?){2,5}\d{2,}(?!\w)"
)
IPV4 = (
    r"(?<!\d)(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)(?!\d)"
)
IPV6 = (
    r"(?<![:\w])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,7}:"
    r"|:(?::[0-9A-Fa-f]{1,4}){1,7}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,6}:[0-9A-Fa-f]{1,4}"
    r"|::(?:[fF]{4}(?::0{1,4})?:)?(?:25[0-5]|2[0-4]\d|[01]?\d\d?)(?:\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)){3}"
)
CREDIT_CARD = (
    r"(?<!\d)(?:4\d{3}|5[1-5]\d{2}|6011|3[47]\d{2})[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{0,4}(?!\d)"
)
CARD_DIGIT_COUNTS = (13, 15, 16)
IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{1,30}\b"
IBAN_MIN_CHARS = 15
SSN = r"(?<!\d)(?!000|666|9\d{2})\d{3}[\s\-]\d{2}[\s\-]\d{4}(?!\d)"
EMPLOYEE_ID = r"\b[A-Z]-\d{4,6}\b"
PHONE_MIN_DIGITS = 7

# Labels in front of a value that runs to the end of its line.
LINE_VALUE = r"(?im)\b(?:{labels})\b\s*[:\-]\s*(?P<val>.+?)\s*$"
FAX_LABELS = r"fax|fax\s*number|telefax"
PHONE_LABELS = r"phone|telephone|tel|mobile|mobil|cell|telefon"
USERNAME_LABELS = r"username|user\s*name|login|user\s*id|account"
SIGNATURE_LABELS_DOCUMENT = r"signature|signed\s+by|unterschrift|signature\s+block"
SIGNATURE_LABELS_FORM = r"signature|signed\s*by|unterschrift|signature\s*block"
BILLING_LABELS = (
    r"billing\s*address|shipping\s*address|invoice\s*address|delivery\s*address"
)
ADDRESS_LABELS = r"address|home\s*address|anschrift|adresse|residence"

# Labels in front of an identity-document token.
ID_VALUE = r"(?im)\b(?:{labels})\b\s*[:\-]?\s*(?P<val>{token})"
ID_TOKEN_DOCUMENT = r"[A-Za-z]{0,3}[\-\s]?[A-Za-z0-9][A-Za-z0-9\-/.]{2,}"
ID_TOKEN_FORM = r"[A-Za-z]{0,3}[\- ]?[A-Za-z0-9][A-Za-z0-9\-/.]{2,}"
PASSPORT_LABELS = r"passport(?:\s*(?:no\.?|number))?|reisepass"
LICENSE_LABELS = r"driver'?s?\s*licen[cs]e(?:\s*(?:no\.?|number))?|f[üu]hrerschein"
ID_CARD_LABELS = (
    r"id\s*card(?:\s*(?:no\.?|number))?|identity\s*card|personalausweis|"
    r"ausweis(?:nummer)?|tax\s*id|vat\s*id"
)

# Labelled date of birth.
DATE_OF_BIRTH = (
    r"(?im)\b(?:dob|date\s+of\s+birth|born|geburtsdatum|birthdate)\b[\s:.\-]*"
    r"(?P<val>\d{1,2}[\s./\-]\d{1,2}[\s./\-]\d{2,4}|\d{4}[\s./\-]\d{2}[\s./\-]\d{2})"
)

# Form-only patterns.
NAME_LABELS = (
    r"name|employee|participant|manager|reviewer|approver|trainer|"
    r"contact\s*person|owner|requested\s*by|prepared\s*by|applicant"
)
NAME = (
    r"(?im)\b(?:{labels})\b[ \t]*[:\-][ \t]*"
    r"(?P<val>[A-Z][\w.'-]+(?:[ \t]+[A-Z][\w.'-]+){{0,3}})"
)
PHOTO_VIDEO = (
    r"(?i)\b(?:passport\s+photo|photo\s+id|headshot|profile\s+(?:photo|picture|image)|"
    r"(?:photo|picture|image|video)\s+(?:attached|enclosed|of\s+the\s+(?:employee|person|applicant))|"
    r"\.(?:jpg|jpeg|png|mp4|mov)\b)"
)
STREET = r"(?i)\b[A-ZÄÖÜ][a-zäöüß.]+(?:str\.?|straße|gasse|weg|allee|platz)\.?\s*\d+"
POSTAL = r"\b\d{5}[ \t]+[A-ZÄÖÜ][a-zäöüß]+"
TRAVEL = (
    r"(?i)\b(?:round[\- ]trip|one[\- ]way|itinerary|boarding\s+pass|"
    r"flight\s+[A-Z]{2}\d{2,4}|"
    r"travel(?:led|ling)?\s+to\s+[A-Z][a-z]+|trip\s+to\s+[A-Z][a-z]+|"
    r"[A-Z][a-z]+\s*(?:->|→)\s*[A-Z][a-z]+)"
)
ROLE_WORDS = (
    "lead", "team", "desk", "service", "ops", "governance", "manager", "reviewer",
    "approver", "participant", "owner", "trainer", "department", "it", "hr",
    "procurement", "operations", "support", "admin", "staff", "group", "office",
    "compliance", "officer", "identity", "access", "vendor", "management",
    "facility", "coordinator", "catalog", "unit", "committee", "board",
)

# Category -> (label, icon, priority, accent colour, reason).
CATEGORIES = {
    "name": ("Name", "👤", "low", "#e05c2a",
             "Direct identifier — names must be minimised and erased after retention."),
    "username": ("Username / login", "🆔", "low", "#e05c2a",
                 "Account/login identifier ties activity to a person."),
    "email": ("Email address", "📧", "medium", "#3868c8",
              "Contact data — directly identifies and reaches an individual."),
    "signature": ("Signature", "✍️", "high", "#7c38b8",
                  "Biometric-adjacent identifier; high re-identification value."),
    "photo_video": ("Photo / video", "📷", "high", "#7c38b8",
                    "Image of a person — sensitive identifier requiring protection by design."),
    "phone": ("Phone number", "📞", "medium", "#3868c8",
              "Contact data — directly reaches an individual."),
    "fax": ("Fax number", "📠", "medium", "#3868c8",
            "Contact data tied to an individual or office."),
    "home_address": ("Home address", "🏠", "medium", "#d4880c",
                     "Location data — strong quasi-identifier."),
    "billing_shipping_address": ("Billing / shipping", "📦", "medium", "#d4880c",
                                 "Location + transaction data linking a person to activity."),
    "passport": ("Passport number", "🛂", "high", "#b8102e",
                 "Government identifier — high-risk, requires security of processing."),
    "id_card": ("ID card number", "🪪", "high", "#b8102e",
                "Government identifier — high-risk, requires security of processing."),
    "drivers_license": ("Driver's license", "🚗", "high", "#b8102e",
                        "Government identifier — high-risk, requires security of processing."),
    "travel_history": ("Travel history", "✈️", "low", "#d4880c",
                       "Movement data — reveals patterns of life; storage must be limited."),
}
DEFAULT_ICON = "•"
DEFAULT_COLOUR = "#7e92a8"
ARTICLES_ALL = ("Art. 5", "Art. 17")
ARTICLES_HIGH = ("Art. 5", "Art. 17", "Art. 25", "Art. 32")
ARTICLES_CONTACT = ("Art. 5", "Art. 17", "Art. 25")
CONTACT_CATEGORIES = ("home_address", "billing_shipping_address", "email", "phone")
PRIORITY_RANK = {"high": 0, "medium": 1, "low": 2}

# Entity names of the recogniser -> category, and its selection modes.
ENTITY_CATEGORY = {
    "Person": "name",
    "PersonType": "name",
    "Email": "email",
    "PhoneNumber": "phone",
    "Address": "home_address",
    "IPAddress": "ip_address",
}
ENTITY_MODES = {
    "gdpr_minimal": (
        "Person", "EmailAddress", "PhoneNumber", "IpAddress", "PersonalData", "SensitiveData",
    ),
    "gdpr_full": (
        "DataController", "DataProcessor", "PersonalData", "SensitiveData", "LegalBasis",
        "RetentionPeriod", "DataSubjectRights", "DataBreach", "ThirdCountryTransfer",
        "SecurityMeasure", "Person", "EmailAddress", "PhoneNumber", "IpAddress",
    ),
}
FALLBACK_ENTITY_MODE = "gdpr_minimal"
ENTITY_MIN_CONFIDENCE = 0.85
VERIFY_BELOW = 0.9
ESCALATE_BELOW = 0.75
VERIFY_TEXT_CHARS = 6000
DETECT_TEXT_CHARS = 8000
EXCERPT_CHARS = 1200
FORM_LABEL = r"(?m)^[^:\n]{1,40}:\s*"

# Exported document types -> (export type, extension); stored types -> extension.
EXPORT_TYPES = {
    "application/vnd.google-apps.document": (
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".docx"),
    "application/vnd.google-apps.spreadsheet": ("text/csv", ".csv"),
    "application/vnd.google-apps.presentation": (
        "application/vnd.openxmlformats-officedocument.presentationml.presentation", ".pptx"),
}
STORED_TYPES = {
    "application/pdf": ".pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
    "text/plain": ".txt",
    "text/csv": ".csv",
    "text/html": ".html",
    "application/rtf": ".rtf",
    "image/png": ".png",
    "image/jpeg": ".jpg",
    "image/jpg": ".jpg",
    "image/tiff": ".tiff",
    "image/bmp": ".bmp",
    "image/webp": ".webp",
    "video/mp4": ".mp4",
    "video/quicktime": ".mov",
    "video/x-msvideo": ".avi",
    "video/x-matroska": ".mkv",
    "video/webm": ".webm",
    "video/mpeg": ".mpeg",
    "video/3gpp": ".3gp",
    "video/3gpp2": ".3g2",
}
DEFAULT_OWNER = "admin@admin.com"
SCAN_EXTENSIONS = (".pdf", ".docx", ".doc", ".txt")
TEXT_EXTENSIONS = (".txt", ".md", ".log", ".json", ".xml", ".yaml", ".yml")
BENCHMARK_EXTENSIONS = (".txt", ".pdf", ".docx", ".xlsx", ".csv", ".pptx")
CLEAN_STEM_PREFIX = "internal_memo_"
OCR_MIN_CHARS = 80

# Base-name keyword -> (source type, steward); the first hit wins.
STORE_RULES = (
    ("expense", "onedrive", None),
    ("training", "onedrive", None),
    ("it_access", "sharepoint", "steward_it"),
    ("supplier", "sharepoint", "steward_proc"),
    ("incident", "fileshare", "steward_comp"),
)
DEFAULT_STORE = ("fileshare", "steward_comp")
PERSONAL_STORE = "onedrive"

# Review vocabulary.
ACTION_STATUS = {"confirm_delete": "delete", "keep": "keep", "false_positive": "false_positive"}
DECISION_ACTION = {"deleted": "confirm_delete", "cancelled": "false_positive", "extended": "keep"}
RETENTION_YEARS = 3
SECONDS_PER_YEAR = 365.25 * 86400

# Markup of the document preview and wording of the explanation.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
EXPLAIN_FLAGGED = "“{name}” was flagged because the scanner detected {n} {items} of personal data — {types}. "
EXPLAIN_DUTY = (
    "Under GDPR this kind of data must be minimised and erased once it is no longer needed "
    "({articles}). "
)
EXPLAIN_REVIEW = (
    "Review each finding below and decide whether the file is still required for business, "
    "or should be cleaned up."
)
PROMPT_HEAD = (
    "You are a GDPR compliance assistant for an internal data-discovery tool.",
    "In 2–3 short, plain-English sentences, explain to the file's owner WHY this",
    "file was flagged as containing personal data, and what GDPR risk it poses.",
    "Be concise and non-alarming. Do not repeat the raw values; refer to the data types.",
    "",
)
