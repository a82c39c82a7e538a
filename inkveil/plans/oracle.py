"""SQL of the queries for DuckDB. Its patterns are written out here on their own, so that a wrong one in the catalogue shows."""

from __future__ import annotations

from ..functions.catalogue import PRESETS

# What each detector matches, in RE2: category, pattern, group, least digits, checksum, in the order of the catalogue.
# RE2 has no look-around: a phone number takes its neighbours along, and a bare account is a whole token of digits.
_SEP = r"[ \t]*[:#.\-]?[ \t]*"
_MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_PHONE = r"(?:\+?1[\s.\-]?)?\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}"
RULES: dict[str, tuple[str, str, int, int, str]] = {
    "email": ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0, 0, ""),
    "phone": ("phone", rf"(?:^[.\-]?|[^0-9.\-]|[^0-9][.\-])({_PHONE})(?:[.\-]?[^0-9.\-]|[.\-]{{2}}|[.\-]?$)", 1, 0, ""),
    "ssn": ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", 0, 0, ""),
    "ssn_labelled": ("ssn", rf"(?i)(?:SSN|Soc(?:ial)?\.?[ \t]*Sec(?:urity)?\.?(?:[ \t]*(?:No|Num(?:ber)?|#))?){_SEP}(\d{{3}}[ \-]?\d{{2}}[ \-]?\d{{4}})", 1, 0, ""),
    "ein": ("tax_id", r"\b\d{2}-\d{7}\b", 0, 0, ""),
    "tax_labelled": ("tax_id", rf"(?i)(?:EIN|TIN|ITIN|Tax(?:payer)?[ \t]*ID(?:[ \t]*(?:No|Num(?:ber)?|#))?){_SEP}([\d\-]{{9,11}})", 1, 9, ""),
    "account_labelled": ("account_number", rf"(?i)(?:account|acct|a/c)[ \t]*(?:no|num(?:ber)?|#)?{_SEP}([A-Z0-9][A-Z0-9\-]{{4,24}}\d)", 1, 5, ""),
    "account_masked": ("account_number", r"(?:[Xx*•]{2,}[\s\-]?){1,4}\d{2,6}\b", 0, 0, ""),
    "account_bare": ("account_number", r"[.,$\-]?\d+(?:[.,]\d+)*", 0, 0, "bare"),
    "card_16": ("credit_card", r"\b\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}\b", 0, 0, "luhn"),
    "card_15": ("credit_card", r"\b\d{4}[ \-]\d{6}[ \-]\d{5}\b", 0, 0, "luhn"),
    "routing_labelled": ("routing_number", rf"(?i)(?:routing|ABA|RTN)[ \t]*(?:no|num(?:ber)?|#)?{_SEP}(\d{{9}})\b", 1, 0, ""),
    "routing_bare": ("routing_number", r"\b\d{9}\b", 0, 0, "aba"),
    "mrn": ("mrn", rf"(?i)(?:MRN|Med(?:ical)?\.?[ \t]*Rec(?:ord)?\.?[ \t]*(?:No|Num(?:ber)?|#)?|Patient[ \t]*(?:ID|No|Num(?:ber)?|#)){_SEP}([A-Z0-9\-]{{4,15}})", 1, 2, ""),
    "insurance": ("insurance_id", rf"(?i)(?:Member|Policy|Subscriber|Group|Insurance|Plan)[ \t]*(?:ID|No|Num(?:ber)?|#){_SEP}([A-Z0-9\-]{{5,20}})", 1, 3, ""),
    "insurance_public": ("insurance_id", rf"(?i)(?:Medicare|Medicaid|MBI)[ \t]*(?:ID|No|Num(?:ber)?|#)?{_SEP}([A-Z0-9][A-Z0-9\-]{{6,15}})", 1, 3, ""),
    "licence": ("drivers_license", rf"(?i)(?:Driver'?s?[ \t]*Lic(?:ense)?\.?|D\.?L\.?[ \t]*(?:No|Num(?:ber)?|#)|Lic(?:ense)?[ \t]*(?:No|Num(?:ber)?|#)){_SEP}([A-Z0-9][A-Z0-9\-]{{3,15}})", 1, 3, ""),
    "passport": ("passport", rf"(?i)Passport[ \t]*(?:No|Num(?:ber)?|#|Book)?{_SEP}([A-Z0-9][A-Z0-9\-]{{5,12}})", 1, 4, ""),
    "dob": ("dob", rf"(?i)(?:DOB|D\.O\.B\.?|Date[ \t]*of[ \t]*Birth|Birth[ \t]*Date|Born){_SEP}((?:\d{{1,2}}[/\-.]\d{{1,2}}[/\-.]\d{{2,4}}|{_MONTH}\.?\s+\d{{1,2}},?\s+\d{{4}}))", 1, 0, ""),
    "street": ("address", r"\b\d{1,6}\s+[A-Z][A-Za-z]*(?:\s+[A-Za-z]+){0,3}\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Circle|Cir|Way|Place|Pl|Terrace|Ter|Trail|Trl|Parkway|Pkwy|Highway|Hwy|Loop|Square|Sq)\.?(?:[,\s]+(?:Apt|Apartment|Suite|Ste|Unit|Bldg|Floor|Fl|#)\.?\s*[\w\-]+)?", 0, 0, ""),
    "city": ("address", r"\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?\b", 0, 0, ""),
    "po_box": ("address", r"(?i)\bP\.?\s?O\.?\s?Box\s+\d+\b", 0, 0, ""),
    "case": ("case_number", rf"(?i)(?:Case|Docket|Cause|Matter)[ \t]*(?:No|Num(?:ber)?|#)\.?{_SEP}([A-Z0-9][A-Z0-9:\-]{{3,24}})", 1, 2, ""),
}


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def found(key: str, text: str) -> str:
    """SQL of the list of a detector's matches in a text, before they are checked."""
    _, pattern, group, _, check = RULES[key]
    every = f"regexp_extract_all({text}, {quoted(pattern)}, {group})"
    return rf"list_filter({every}, lambda x: regexp_full_match(x, '\d{{8,17}}'))" if check == "bare" else every


def stands(key: str) -> str:
    """SQL of whether ``matched`` passes the detector's checks."""
    _, _, _, least, check = RULES[key]
    digits = "regexp_replace(matched, '[^0-9]', '', 'g')"
    out = ["length(matched) > 0"]
    if least:
        out.append(f"length({digits}) >= {least}")
    if check == "luhn":
        out.append(f"length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN {digits}[i]::INT ELSE ({digits}[i]::INT * 2) // 10 + ({digits}[i]::INT * 2) % 10 END)) % 10 = 0")
    if check == "aba":
        total = " + ".join(f"{(3, 7, 1)[i % 3]} * {digits}[{i + 1}]::INT" for i in range(9))
        out.append(f"length({digits}) = 9 AND ({total}) % 10 = 0 AND ({total}) > 0")
    return " AND ".join(out)


def scanned(table: str, key: str, text: str, keys: tuple[str, ...] = tuple(RULES), name: str = "m", tabular: bool = False) -> str:
    """Common table expressions that end in ``name`` (key, category, matched): distinct matches of texts and their squeezed copies."""
    parts = " UNION ALL ".join(f"SELECT {key}, {quoted(RULES[k][0])} AS category, matched FROM (SELECT {key}, trim(unnest({found(k, 'src')})) AS matched FROM {name}_src) WHERE {stands(k)}" for k in keys if not (tabular and k == "account_bare"))
    return f"{name}_src AS (SELECT {key}, {text} AS src FROM {table} UNION SELECT {key}, trim(regexp_replace({text}, '[\\s\\x0b]+', ' ', 'g')) AS src FROM {table}), {name} AS (SELECT DISTINCT {key}, category, matched FROM ({parts}))"


def replaced(table: str, key: str, text: str, keys: tuple[str, ...] = tuple(RULES)) -> str:
    """Common table expressions that end in r (key, text, redacted, hits): matches replaced one after the other, the longest first; hits is category:n; for each."""
    order = "[" + ", ".join(quoted(c) for c in dict.fromkeys(r[0] for r in RULES.values())) + "]"
    step = "{'t': replace(a.t, x.m, repeat('█', least(length(x.m), 12))), 'm': x.m, 'c': x.c, 'h': a.h || CASE WHEN contains(a.t, x.m) THEN x.c || ':' || ((length(a.t) - length(replace(a.t, x.m, ''))) // length(x.m))::VARCHAR || ';' ELSE '' END}"
    return (
        f"{scanned(table, key, text, keys)}, "
        f"o AS (SELECT {key}, list({{'t': '', 'm': matched, 'c': category, 'h': ''}} ORDER BY length(matched) DESC, list_position({order}, category), matched) AS ms FROM m GROUP BY {key}), "
        f"f AS (SELECT s.{key}, s.{text} AS text, list_reduce(list_prepend({{'t': s.{text}, 'm': '', 'c': '', 'h': ''}}, coalesce(ms, [])), lambda a, x: {step}) AS z FROM {table} s LEFT JOIN o USING ({key})), "
        f"r AS (SELECT {key}, text, z.t AS redacted, z.h AS hits FROM f)"
    )


#: Categories of presets, as a table.
PRESET_ROWS = " UNION ALL ".join(f"SELECT {quoted(p)} AS preset, {quoted(c)} AS category" for p, cs in PRESETS.items() for c in cs)
