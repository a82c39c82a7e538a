"""What counts as an identifier: patterns, categories, labels and presets."""

from __future__ import annotations

from dataclasses import dataclass

# The patterns, months and separators below decide which strings
# are found, and labels and presets how users name them, so they are stated
# exactly. One capturing group, where there is one, is the part that is removed.
MONTHS = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE = r"(?:\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|" + MONTHS + r"\.?\s+\d{1,2},?\s+\d{4})"
SEP = r"[ \t]*[:#.\-]?[ \t]*"
NUM = r"(?:No|Num(?:ber)?|#)"


@dataclass(frozen=True)
class Pattern:
    """A detector. check: name of a validator or None; digits: least digits a match needs; bare: left out of tables."""

    key: str
    category: str
    body: str
    group: int = 0
    any_case: bool = False
    check: str | None = None
    digits: int = 0
    bare: bool = False
    #: Lower-case strings of which a text must hold one to be worth the scan; none: any text is.
    signs: tuple[str, ...] = ()

    @property
    def java(self) -> str:
        return ("(?iuU)" if self.any_case else "(?U)") + self.body

    @property
    def re2(self) -> str:
        return ("(?i)" if self.any_case else "") + self.body


PATTERNS = (
    Pattern("email", "email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", signs=("@",)),
    Pattern("phone", "phone", r"(?<!\d)(?<!\d[.\-])(?:\+?1[\s.\-]?)?\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}(?!\d)(?![.\-]\d)"),
    Pattern("ssn", "ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    Pattern("ssn_labelled", "ssn", r"(?:SSN|Soc(?:ial)?\.?[ \t]*Sec(?:urity)?\.?(?:[ \t]*" + NUM + ")?)" + SEP + r"(\d{3}[ \-]?\d{2}[ \-]?\d{4})", 1, True, signs=("ssn", "soc")),
    Pattern("ein", "tax_id", r"\b\d{2}-\d{7}\b"),
    Pattern("tax_labelled", "tax_id", r"(?:EIN|TIN|ITIN|Tax(?:payer)?[ \t]*ID(?:[ \t]*" + NUM + ")?)" + SEP + r"([\d\-]{9,11})", 1, True, digits=9, signs=("ein", "tin", "tax")),
    Pattern("account_labelled", "account_number", r"(?:account|acct|a/c)[ \t]*(?:no|num(?:ber)?|#)?" + SEP + r"([A-Z0-9][A-Z0-9\-]{4,24}\d)", 1, True, digits=5, signs=("account", "acct", "a/c")),
    Pattern("account_masked", "account_number", r"(?:[Xx*•]{2,}[\s\-]?){1,4}\d{2,6}\b"),
    Pattern("account_bare", "account_number", r"(?<![\d.,$\-])\d{8,17}(?!\d)(?![.,]\d)", bare=True),
    Pattern("card_16", "credit_card", r"\b\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}\b", check="luhn"),
    Pattern("card_15", "credit_card", r"\b\d{4}[ \-]\d{6}[ \-]\d{5}\b", check="luhn"),
    Pattern("routing_labelled", "routing_number", r"(?:routing|ABA|RTN)[ \t]*(?:no|num(?:ber)?|#)?" + SEP + r"(\d{9})\b", 1, True, signs=("routing", "aba", "rtn")),
    Pattern("routing_bare", "routing_number", r"\b\d{9}\b", check="aba"),
    Pattern("mrn", "mrn", r"(?:MRN|Med(?:ical)?\.?[ \t]*Rec(?:ord)?\.?[ \t]*" + NUM + r"?|Patient[ \t]*(?:ID|No|Num(?:ber)?|#))" + SEP + r"([A-Z0-9\-]{4,15})", 1, True, digits=2, signs=("mrn", "med", "patient")),
    Pattern("insurance", "insurance_id", r"(?:Member|Policy|Subscriber|Group|Insurance|Plan)[ \t]*(?:ID|No|Num(?:ber)?|#)" + SEP + r"([A-Z0-9\-]{5,20})", 1, True, digits=3, signs=("member", "policy", "subscriber", "group", "insurance", "plan")),
    Pattern("insurance_public", "insurance_id", r"(?:Medicare|Medicaid|MBI)[ \t]*(?:ID|No|Num(?:ber)?|#)?" + SEP + r"([A-Z0-9][A-Z0-9\-]{6,15})", 1, True, digits=3, signs=("medicare", "medicaid", "mbi")),
    Pattern("licence", "drivers_license", r"(?:Driver'?s?[ \t]*Lic(?:ense)?\.?|D\.?L\.?[ \t]*" + NUM + r"|Lic(?:ense)?[ \t]*" + NUM + ")" + SEP + r"([A-Z0-9][A-Z0-9\-]{3,15})", 1, True, digits=3, signs=("lic", "dl", "d.l")),
    Pattern("passport", "passport", r"Passport[ \t]*(?:No|Num(?:ber)?|#|Book)?" + SEP + r"([A-Z0-9][A-Z0-9\-]{5,12})", 1, True, digits=4, signs=("passport",)),
    Pattern("dob", "dob", r"(?:DOB|D\.O\.B\.?|Date[ \t]*of[ \t]*Birth|Birth[ \t]*Date|Born)" + SEP + "(" + DATE + ")", 1, True, signs=("dob", "d.o.b", "birth", "born")),
    Pattern("street", "address", r"\b\d{1,6}\s+[A-Z][A-Za-z]*(?:\s+[A-Za-z]+){0,3}\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Circle|Cir|Way|Place|Pl|Terrace|Ter|Trail|Trl|Parkway|Pkwy|Highway|Hwy|Loop|Square|Sq)\.?(?:[,\s]+(?:Apt|Apartment|Suite|Ste|Unit|Bldg|Floor|Fl|#)\.?\s*[\w\-]+)?"),
    Pattern("city", "address", r"\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?\b"),
    Pattern("po_box", "address", r"\bP\.?\s?O\.?\s?Box\s+\d+\b", any_case=True, signs=("box",)),
    Pattern("case", "case_number", r"(?:Case|Docket|Cause|Matter)[ \t]*" + NUM + r"\.?" + SEP + r"([A-Z0-9][A-Z0-9:\-]{3,24})", 1, True, digits=2, signs=("case", "docket", "cause", "matter")),
)

LABELS = {
    "email": "Email addresses",
    "phone": "Phone numbers",
    "ssn": "Social Security numbers",
    "tax_id": "Tax IDs (EIN/TIN)",
    "account_number": "Account numbers",
    "credit_card": "Credit/debit card numbers",
    "routing_number": "Routing numbers",
    "drivers_license": "Driver's license numbers",
    "passport": "Passport numbers",
    "link": "Hyperlinks with sensitive data",
    "mrn": "MRNs / patient IDs",
    "insurance_id": "Insurance / member IDs",
    "dob": "Dates of birth",
    "address": "Addresses",
    "case_number": "Case / docket numbers",
    "custom": "Custom terms (from config)",
    "face": "Detected faces (Vision)",
    "handwriting": "Handwriting regions (Vision)",
}
#: In catalogue order, which breaks ties between equal matches.
CATEGORIES = tuple(dict.fromkeys(p.category for p in PATTERNS))
PRESETS = {
    "financial": ("account_number", "credit_card", "routing_number", "tax_id", "ssn", "address", "phone", "email", "dob"),
    "medical": ("mrn", "insurance_id", "credit_card", "dob", "ssn", "address", "phone", "email"),
    "legal": ("case_number", "drivers_license", "passport", "ssn", "dob", "address", "phone", "email"),
    "general": CATEGORIES,
}
#: What presets do not find, said in reports.
NOTES = {
    "financial": "Names are only found where they are listed under custom_terms.",
    "medical": "Names of patients and doctors are only found where they are listed under custom_terms.",
    "legal": "Signatures are images and cannot be found; pages with images are flagged for a person to look at.",
    "general": "Names are only found where they are listed under custom_terms.",
}
#: How grave an exit code is: a failed check above an unreadable page, above a file that is locked or not supported.
SEVERITY = {0: 0, 4: 1, 5: 2, 2: 3, 3: 4}
