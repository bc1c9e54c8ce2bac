"""Detection rules as data: one row for each pattern, grouped in packs, composed into policies."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Rule:
    """A pattern and what its matches must pass. ``check`` names an identity-number test: a pass scores ``passed``,
    a failure ``fallback`` (dropped where that is None). ``before`` must match within the ``window`` characters before
    the match; with ``before_on_fail`` only failed checks need it."""

    name: str
    pack: str
    entity_type: str
    pattern: str
    score: float
    group: int = 0
    check: str | None = None
    passed: float = 1.0
    fallback: float | None = None
    before: str | None = None
    window: int = 40
    before_on_fail: bool = False
    digits: tuple[int, int] | None = None
    ignore_case: bool = False
    shape: str | None = None


# --- fixed values: patterns, scores and types that decide what is found --------------------------
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[A-Za-z]{2,}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\b"
PHONE = r"(?:\+\d{1,3}[\s\-.]*\(?\d{1,4}\)?(?:[\s\-.]*\d{2,4}){1,4}|\(?\b\d{3,4}\)?[\s\-.]\d{3,4}[\s\-.]\d{2,4}(?:[\s\-.]\d{2,4})?\b)"
IBAN = r"\b[A-Za-z]{2}\d{2}[\s0-9A-Za-z]{11,32}"
NAME_AFTER_LABEL = r":\s*\n\s*([^\W\d_]{2,20})\s*(?:\n|$)"
CARD = r"\b(?:4\d{3}|5[1-5]\d{2}|2[2-7]\d{2}|3[4-9]\d{2}|3[0-3]\d{2}|6(?:011|5\d{2}|4[4-9]\d|22[1-9]|\d{3})|35\d{2})[\s\-]?\d{3,4}[\s\-]?\d{3,4}[\s\-]?\d{3,5}\b"
MAC = r"\b(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}\b|\b(?:[0-9A-Fa-f]{4}\.){2}[0-9A-Fa-f]{4}\b"
URL = r"https?://[^\s<>\"')\]},;]+"
COORDINATES = r"-?\d{1,3}\.\d{3,8}\s*[°]?\s*[NSns]?\s*[,/;\s]\s*-?\d{1,3}\.\d{3,8}\s*[°]?\s*[EWew]?"
COORDINATES_DMS = r"\d{1,3}°\s*\d{1,2}[′']\s*\d{1,2}(?:\.\d+)?[″\"]\s*[NSns]\s*\d{1,3}°\s*\d{1,2}[′']\s*\d{1,2}(?:\.\d+)?[″\"]\s*[EWew]"
COOKIE_GA = r"_ga\s*=\s*GA\d\.\d+\.\d+\.\d+"
COOKIE_UUID = r"(?:cookie|session[_\-]?id|tracking[_\-]?id)\s*[=:]\s*[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
DEVICE_IMEI = r"(?:IMEI|imei)\s*[=:]\s*\d{15,17}"
DEVICE_UUID = r"(?:device[_\-]?id|android[_\-]?id|udid|idfa|idfv|gaid)\s*[=:]\s*[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
DEVICE_SERIAL = r"(?:serial\s*(?:number|no|#)?|s/n)\s*[=:]\s*[A-Za-z0-9]{8,20}"
SSN = r"\b\d{3}[\s\-]?\d{2}[\s\-]?\d{4}\b"
SSN_BEFORE = r"(?:SSN|social\s*security)"
CPF = r"\b\d{3}\.?\d{3}\.?\d{3}[\-.]?\d{2}\b"
CPF_BEFORE = r"\bcpf\b"
PASSPORT = r"\b[A-Z]{0,2}\d{6,9}\b"
PASSPORT_BEFORE = r"(?:passport|pasaport|reisepass|passeport|passaporto|paspoort|паспорт|جواز\s*سفر|护照|パスポート|पासपोर्ट)"
LICENSE = r"\b[A-Z0-9]{5,15}\b"
LICENSE_BEFORE = (
    r"(?:driver'?s?\s*licen[sc]e|driving\s*licen[sc]e|DL\s*#?|ehliyet|permis\s*de\s*conduire|führerschein|rijbewijs|patente\s*di\s*guida"
    r"|licencia\s*de\s*conducir|carta\s*de\s*condução|водительское\s*удостоверение)"
)
TAX = (
    r"(?:\b[A-Z]{2}\s?\d{2}\s?\d{6,10}\b|\b[A-Z]-?\d{7,8}[A-Z0-9]?\b|\b\d{2,3}/\d{3,4}/\d{4,5}\b|\b\d{2,3}(?:\.\d{3}){2,3}(?:[-.]\d{1,2})?\b"
    r"|\b\d{2}\s\d{3}\s\d{3}\s\d{3}\b|\b\d{2}[\-]?\d{7,10}\b)"
)
TAX_BEFORE = (
    r"(?:tax\s*id|TIN|EIN|vergi\s*(?:no|numarası|kimlik)|steuer[\-\s]?(?:nummer|id)|ust[\-\s]?id|USt[\-\s]?IdNr|NIF|CIF|NIE|N(?:º|[oO]\.?)\s*SIREN|SIRET"
    r"|tva\s*intracommunautaire|codice\s*fiscale|partita\s*iva|numéro\s*fiscal|inscrição\s*estadual|CNPJ|CPF|ИНН|الرقم\s*الضريبي|税号)"
)
PLATE = r"\b\d{2}\s*[A-Z]{1,3}\s*\d{2,4}\b|\b[A-Z]{1,3}[\s\-]?\d{1,4}[\s\-]?[A-Z]{0,3}\b"
PLATE_BEFORE = (
    r"(?:licen[sc]e\s*plate|plate\s*(?:no|number)|plaka|vehicle\s*reg|kennzeichen|immatriculation|targa|matrícula|kenteken|номерной\s*знак|لوحة\s*السيارة|车牌|ナンバープレート)"
)
MONTHS = (
    "january february march april may june july august september october november december "
    "januar februar märz maerz april mai juni juli august september oktober november dezember "
    "janvier février fevrier mars avril mai juin juillet août aout septembre octobre novembre décembre decembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
    "janeiro fevereiro março marco abril maio junho julho agosto setembro outubro novembro dezembro "
    "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre "
    "ocak şubat subat mart nisan mayıs mayis haziran temmuz ağustos agustos eylül eylul ekim kasım kasim aralık aralik"
).split()
BIRTH_BEFORE = (
    r"(?:d\.?o\.?b\.?|birth\s*date|date\s*of\s*birth|born\s*(?:on)?|naissance|nacimiento|nascimento|geburtsdatum|geboortedatum|data\s*di\s*nascita"
    r"|do[gğ]um\s*tarihi|fecha\s*de\s*nacimiento|data\s*de\s*nascimento|дата\s*рождения|تاريخ\s*الميلاد|出生日期|生年月日|जन्म\s*तिथि)"
)
_MONTH = "|".join(sorted(set(MONTHS), key=lambda m: (-len(m), m)))
BIRTH_DATE = (
    r"(?:\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b|\b\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2}\b"
    rf"|\b\d{{1,2}}\.?\s+(?:de\s+)?(?:{_MONTH})\s+(?:de\s+)?\d{{2,4}}\b|\b(?:{_MONTH})\s+\d{{1,2}}(?:,)?\s+\d{{2,4}}\b)"
)
#: Abbreviations that mark a street address.
STREET_WORDS = "NO APT FLAT UNIT BLOCK BLK BLDG ST STR AVE AV BLV BLVD MAH MH SK SOK CD CAD KAT".split()
_STREET = "|".join(sorted(STREET_WORDS, key=lambda w: (-len(w), w)))
ADDRESS_CUE = rf"(?:(?:{_STREET})\b\.?)|(?:[A-Za-z]+\s*[:./]\s*\d+)"
ADDRESS_LABEL = r"(?m)^(\S[^:\n]{1,40})\s*:\s*(.+)$"
#: Length of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20,
}

BASELINE: tuple[Rule, ...] = (
    Rule("phone", "baseline", "PHONE_NUMBER", PHONE, 0.80, digits=(9, 15)),
    Rule("iban", "baseline", "IBAN", IBAN, 0.96, fallback=0.65, shape="iban"),
    Rule("name_after_label", "baseline", "PERSON_NAME", NAME_AFTER_LABEL, 0.80, group=1, shape="capital"),
    Rule("address", "baseline", "POSTAL_ADDRESS", ADDRESS_LABEL, 0.82, fallback=0.78, shape="address"),
    Rule("card", "baseline", "CREDIT_CARD_NUMBER", CARD, 0.85, digits=(13, 19)),
    Rule("birth_date", "baseline", "DATE_OF_BIRTH", BIRTH_DATE, 0.96, before=BIRTH_BEFORE, ignore_case=True),
    Rule("mac", "baseline", "MAC_ADDRESS", MAC, 0.90),
    Rule("url", "baseline", "URL", URL, 0.90, ignore_case=True),
    Rule("coordinates", "baseline", "COORDINATES", COORDINATES, 0.85),
    Rule("coordinates_dms", "baseline", "COORDINATES", COORDINATES_DMS, 0.85),
    Rule("cookie_ga", "baseline", "COOKIE_ID", COOKIE_GA, 0.88),
    Rule("cookie_uuid", "baseline", "COOKIE_ID", COOKIE_UUID, 0.88, ignore_case=True),
    Rule("device_imei", "baseline", "DEVICE_ID", DEVICE_IMEI, 0.85),
    Rule("device_uuid", "baseline", "DEVICE_ID", DEVICE_UUID, 0.85, ignore_case=True),
    Rule("device_serial", "baseline", "DEVICE_ID", DEVICE_SERIAL, 0.85, ignore_case=True),
    Rule("ssn", "baseline", "SOCIAL_SECURITY_NUMBER", SSN, 0.92, check="ssn", passed=0.92, fallback=0.55, before=SSN_BEFORE),
    Rule("cpf", "baseline", "CPF", CPF, 0.95, check="cpf", passed=0.95, fallback=0.55, before=CPF_BEFORE, before_on_fail=True),
    Rule("passport", "baseline", "PASSPORT_NUMBER", PASSPORT, 0.88, before=PASSPORT_BEFORE, window=50),
    Rule("drivers_license", "baseline", "DRIVERS_LICENSE", LICENSE, 0.85, before=LICENSE_BEFORE, window=50, shape="digit"),
    Rule("tax", "baseline", "TAX_ID", TAX, 0.85, before=TAX_BEFORE, ignore_case=True),
    Rule("plate", "baseline", "LICENSE_PLATE", PLATE, 0.84, before=PLATE_BEFORE),
)


def _after(words: str, value: str) -> str:
    return rf"(?i)(?:{words})[^\w]{{0,16}}({value})"


def _pack(pack: str, *rows: tuple) -> tuple[Rule, ...]:
    mail = Rule(f"{pack}_email", pack, "EMAIL_ADDRESS", EMAIL, 0.8)
    rules = [Rule(f"{pack}_{r[0]}", pack, *r[1:4], **(r[4] if len(r) > 4 else {})) for r in rows]
    return (mail, *rules) if pack == "gdpr" else (*rules, mail)


_G1 = {"group": 1}
_KVKK = {"group": 1, "check": "tckn", "fallback": 0.5}
PACKS: dict[str, tuple[Rule, ...]] = {
    "gdpr": _pack(
        "gdpr",
        ("ipv4", "IP_ADDRESS", IPV4, 0.8),
        ("letter_8_digits", "NATIONAL_ID", _after(r"personalausweis(?:\s*[\-\s]?\s*nr\.?)?|ausweis\s*[\-\s]?\s*nr\.?|id\s*[\-\s]?\s*karte|identity\s*card", r"[A-Z]\d{8}"), 0.75, _G1),
        ("tax_11_digits", "TAX_ID", _after(r"steuer\s*[\-\s]?\s*id|steuerliche\s+id|steueridentifikationsnummer|identifikationsnummer", r"\d{2}\s?\d{3}\s?\d{3}\s?\d{3}|\d{11}"), 0.8, _G1),
        ("pension", "NATIONAL_ID", _after(r"rentenversicherungs?\s*[\-\s]?\s*nr\.?|sozialversicherungs?\s*[\-\s]?\s*nr\.?|rv\s*[\-\s]?\s*nr|sv\s*[\-\s]?\s*nr", r"\d{2}\s?\d{6}\s?[A-Z]\s?\d{3}"), 0.8, _G1),
        ("8_digits_letter", "NATIONAL_ID", _after(r"\bdni\b|documento\s+nacional", r"\d{1,3}(?:\.\d{3}){2}[\-\s]?[A-Z]|\d{8}[\-\s]?[A-Z]"), 0.8, _G1),
        ("foreigner", "NATIONAL_ID", _after(r"\bnie\b|n[úu]mero\s+de\s+identificaci[óo]n\s+de\s+extranjero", r"[XYZxyz]\d{7}[A-Z]"), 0.8, _G1),
        ("social_12_digits", "SOCIAL_SECURITY_NUMBER", _after(r"seguridad\s+social|n\.?\s*seguridad\s+social|\bnss\b", r"\d{2}[\s\-/]?\d{2}[\s\-/]?\d{4,8}[\s\-/]?\d{1,2}"), 0.8, _G1),
        ("social_15_digits", "SOCIAL_SECURITY_NUMBER", _after(r"s[eé]curit[eé]\s+sociale|\bnir\b|num[ée]ro\s+de\s+s[eé]curit[eé]\s+sociale", r"\d\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}(?:\s?\d{2})?"), 0.85, _G1),
        ("business_9_digits", "TAX_ID", _after(r"\bsiren\b|\bsiret\b|n°?\s*siren", r"\d{3}\s?\d{3}\s?\d{3}"), 0.75, _G1),
    ),
    "kvkk": _pack(
        "kvkk",
        ("national_id", "NATIONAL_ID", r"\b[1-9][0-9]{10}\b", 0.7, {"check": "tckn", "fallback": 0.55}),
        ("national_id_context", "NATIONAL_ID", r"(?i)\b(?:id|national|citizen|passport|identity|identification|no)\b[^\d]{0,16}(\d{8,12})", 0.6, _KVKK),
        ("national_id_label", "NATIONAL_ID", r"(?i)(?:T\s*\.?\s*C\s*\.?(?:\s+Kimlik(?:\s+No)?)?|TCKN|Kimlik\s+No)[^\d]{0,16}(\d{10,12})", 0.6, _KVKK),
        ("tax_label", "TAX_ID", r"(?i)\b(?:Vergi\s*(?:Kimlik\s*)?No|VKN)\b[^\d]{0,16}(\d{10})", 0.6, _G1),
        ("customer", "CUSTOMER_REFERENCE_ID", r"(?i)\b(?:M[üu]şteri(?:\s+(?:No|Numaras[ıi]))?|[ÜU]ye(?:\s+(?:No|Numaras[ıi]))?|CRM(?:\s+No)?|Hesap\s+No)(?:\s*\([^)]+\))?\s*:?\s*:?\s*([A-Z]{2,8}[-/]\d{2,4}[-/]\d{3,8})", 0.75, _G1),
    ),
    "hipaa": _pack("hipaa", ("mrn", "MEDICAL_RECORD_NUMBER", r"\bMRN[- ]?[0-9]{6,10}\b", 0.8), ("insurance", "HEALTH_INSURANCE_ID", r"\b[A-Z]{2}[0-9]{6,10}\b", 0.75)),
    "lgpd": _pack(
        "lgpd",
        ("cnpj", "TAX_ID", r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b", 0.6),
        ("civil_id", "NATIONAL_ID", _after(r"\brg\b|registro\s+geral|\b(?:ssp|cpf/rg)\b", r"\d{1,3}(?:\.\d{3}){2}[\-\s]?[A-Z0-9]|\d{7,9}[\-\s]?[A-Z0-9]"), 0.8, _G1),
    ),
    "ccpa": _pack("ccpa", ("license", "DRIVERS_LICENSE", r"\b[A-Z]\d{7}\b", 0.55)),
    "cpra": _pack("cpra", ("license", "DRIVERS_LICENSE", r"\b[A-Z]\d{7}\b", 0.55)),
    "uk_gdpr": _pack("uk_gdpr", ("nino", "NATIONAL_ID", r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", 0.75)),
    "pipeda": _pack("pipeda", ("sin", "NATIONAL_ID", r"\b\d{3}[-\s]?\d{3}[-\s]?\d{3}\b", 0.55)),
    "pdpa_th": _pack("pdpa_th", ("national_id", "NATIONAL_ID", r"\b\d[-\s]?\d{4}[-\s]?\d{5}[-\s]?\d{2}[-\s]?\d\b", 0.65)),
    "pdpa_sg": _pack("pdpa_sg", ("nric", "NATIONAL_ID", r"\b[STFGM]\d{7}[A-Z]\b", 0.7)),
    "appi": _pack("appi", ("my_number", "NATIONAL_ID", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", 0.6)),
    "pipl": _pack("pipl", ("resident", "NATIONAL_ID", r"\b\d{17}[\dXx]\b", 0.7)),
    "popia": _pack("popia", ("national_id", "NATIONAL_ID", r"\b\d{6}[\s\-]?\d{4}[\s\-]?\d{3}\b", 0.6)),
    "dpdp": _pack("dpdp", ("aadhaar", "NATIONAL_ID", r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b", 0.75, {"check": "aadhaar", "fallback": 0.55})),
    "pdpl_sa": _pack("pdpl_sa", ("national_id", "NATIONAL_ID", r"\b[12]\d{9}\b", 0.55)),
    "nzpa": _pack("nzpa", ("ird", "TAX_ID", r"\b\d{2,3}[-\s]?\d{3}[-\s]?\d{3}\b", 0.55)),
    "australia_pa": _pack("australia_pa", ("tfn", "TAX_ID", r"\b\d{3}[-\s]?\d{3}[-\s]?\d{2,3}\b", 0.55), ("medicare", "HEALTH_INSURANCE_ID", r"\b\d{4}[-\s]?\d{5}[-\s]?\d\b", 0.6)),
}

#: The types that each pack protects.
_TYPES = {
    "gdpr": "PERSON_NAME FIRST_NAME LAST_NAME EMAIL_ADDRESS PHONE_NUMBER IP_ADDRESS MAC_ADDRESS POSTAL_ADDRESS STREET_ADDRESS CITY DATE_OF_BIRTH NATIONAL_ID PASSPORT_NUMBER TAX_ID BIOMETRIC_ID HEALTH_INSURANCE_ID DIAGNOSIS MEDICATION CLINICAL_NOTE COOKIE_ID DEVICE_ID LOCATION COORDINATES FINANCIAL_ACCOUNT CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER POLITICAL_OPINION RELIGION ETHNICITY SEXUAL_ORIENTATION",
    "kvkk": "PERSON_NAME FIRST_NAME LAST_NAME NATIONAL_ID PASSPORT_NUMBER SOCIAL_SECURITY_NUMBER TAX_ID PHONE_NUMBER EMAIL_ADDRESS POSTAL_ADDRESS STREET_ADDRESS CITY LOCATION COORDINATES DATE_OF_BIRTH LICENSE_PLATE IP_ADDRESS COOKIE_ID DEVICE_ID BIOMETRIC_ID DNA_PROFILE HEALTH_INSURANCE_ID DIAGNOSIS MEDICATION CLINICAL_NOTE RELIGION ETHNICITY POLITICAL_OPINION SEXUAL_ORIENTATION FINANCIAL_ACCOUNT CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER CUSTOMER_REFERENCE_ID",
    "hipaa": "PERSON_NAME DATE_OF_BIRTH PHONE_NUMBER EMAIL_ADDRESS POSTAL_ADDRESS CITY MEDICAL_RECORD_NUMBER HEALTH_INSURANCE_ID DIAGNOSIS MEDICATION CLINICAL_NOTE BIOMETRIC_ID SOCIAL_SECURITY_NUMBER IP_ADDRESS DEVICE_ID LICENSE_PLATE URL",
    "lgpd": "PERSON_NAME CPF NATIONAL_ID EMAIL_ADDRESS PHONE_NUMBER POSTAL_ADDRESS DATE_OF_BIRTH LOCATION IP_ADDRESS COOKIE_ID CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER HEALTH_INSURANCE_ID DIAGNOSIS BIOMETRIC_ID POLITICAL_OPINION RELIGION ETHNICITY SEXUAL_ORIENTATION",
    "ccpa": "PERSON_NAME FIRST_NAME LAST_NAME EMAIL_ADDRESS PHONE_NUMBER POSTAL_ADDRESS STREET_ADDRESS CITY IP_ADDRESS NATIONAL_ID SOCIAL_SECURITY_NUMBER PASSPORT_NUMBER DRIVERS_LICENSE DATE_OF_BIRTH BIOMETRIC_ID FINANCIAL_ACCOUNT CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER DEVICE_ID COOKIE_ID COORDINATES LOCATION RELIGION ETHNICITY SEXUAL_ORIENTATION",
    "cpra": "PERSON_NAME FIRST_NAME LAST_NAME EMAIL_ADDRESS PHONE_NUMBER POSTAL_ADDRESS STREET_ADDRESS CITY IP_ADDRESS NATIONAL_ID SOCIAL_SECURITY_NUMBER PASSPORT_NUMBER DRIVERS_LICENSE DATE_OF_BIRTH BIOMETRIC_ID FINANCIAL_ACCOUNT CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER DEVICE_ID COOKIE_ID COORDINATES LOCATION RELIGION ETHNICITY SEXUAL_ORIENTATION HEALTH_INSURANCE_ID DIAGNOSIS MEDICATION",
    "uk_gdpr": "PERSON_NAME FIRST_NAME LAST_NAME EMAIL_ADDRESS PHONE_NUMBER IP_ADDRESS MAC_ADDRESS POSTAL_ADDRESS STREET_ADDRESS CITY DATE_OF_BIRTH NATIONAL_ID PASSPORT_NUMBER TAX_ID BIOMETRIC_ID HEALTH_INSURANCE_ID DIAGNOSIS MEDICATION CLINICAL_NOTE COOKIE_ID DEVICE_ID LOCATION COORDINATES FINANCIAL_ACCOUNT CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER POLITICAL_OPINION RELIGION ETHNICITY SEXUAL_ORIENTATION",
    "pipeda": "PERSON_NAME FIRST_NAME LAST_NAME EMAIL_ADDRESS PHONE_NUMBER IP_ADDRESS POSTAL_ADDRESS STREET_ADDRESS CITY DATE_OF_BIRTH NATIONAL_ID BIOMETRIC_ID HEALTH_INSURANCE_ID DIAGNOSIS MEDICATION COOKIE_ID DEVICE_ID LOCATION FINANCIAL_ACCOUNT CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER TAX_ID RELIGION ETHNICITY",
    "pdpa_th": "PERSON_NAME FIRST_NAME LAST_NAME EMAIL_ADDRESS PHONE_NUMBER IP_ADDRESS POSTAL_ADDRESS STREET_ADDRESS CITY DATE_OF_BIRTH NATIONAL_ID PASSPORT_NUMBER BIOMETRIC_ID DNA_PROFILE HEALTH_INSURANCE_ID DIAGNOSIS MEDICATION CLINICAL_NOTE COOKIE_ID DEVICE_ID LOCATION COORDINATES FINANCIAL_ACCOUNT CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER RELIGION ETHNICITY POLITICAL_OPINION SEXUAL_ORIENTATION",
    "pdpa_sg": "PERSON_NAME EMAIL_ADDRESS PHONE_NUMBER IP_ADDRESS POSTAL_ADDRESS DATE_OF_BIRTH NATIONAL_ID PASSPORT_NUMBER BIOMETRIC_ID COOKIE_ID DEVICE_ID LOCATION FINANCIAL_ACCOUNT CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER",
    "appi": "PERSON_NAME EMAIL_ADDRESS PHONE_NUMBER IP_ADDRESS POSTAL_ADDRESS DATE_OF_BIRTH NATIONAL_ID PASSPORT_NUMBER BIOMETRIC_ID HEALTH_INSURANCE_ID DIAGNOSIS COOKIE_ID DEVICE_ID LOCATION FINANCIAL_ACCOUNT CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER RELIGION ETHNICITY POLITICAL_OPINION",
    "pipl": "PERSON_NAME EMAIL_ADDRESS PHONE_NUMBER IP_ADDRESS POSTAL_ADDRESS DATE_OF_BIRTH NATIONAL_ID PASSPORT_NUMBER BIOMETRIC_ID COOKIE_ID DEVICE_ID LOCATION COORDINATES FINANCIAL_ACCOUNT CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER HEALTH_INSURANCE_ID DIAGNOSIS RELIGION ETHNICITY",
    "popia": "PERSON_NAME EMAIL_ADDRESS PHONE_NUMBER IP_ADDRESS POSTAL_ADDRESS DATE_OF_BIRTH NATIONAL_ID PASSPORT_NUMBER BIOMETRIC_ID HEALTH_INSURANCE_ID DIAGNOSIS COOKIE_ID DEVICE_ID LOCATION FINANCIAL_ACCOUNT CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER RELIGION ETHNICITY POLITICAL_OPINION SEXUAL_ORIENTATION",
    "dpdp": "PERSON_NAME EMAIL_ADDRESS PHONE_NUMBER IP_ADDRESS POSTAL_ADDRESS DATE_OF_BIRTH NATIONAL_ID PASSPORT_NUMBER BIOMETRIC_ID HEALTH_INSURANCE_ID DIAGNOSIS COOKIE_ID DEVICE_ID LOCATION FINANCIAL_ACCOUNT CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER",
    "pdpl_sa": "PERSON_NAME EMAIL_ADDRESS PHONE_NUMBER IP_ADDRESS POSTAL_ADDRESS DATE_OF_BIRTH NATIONAL_ID PASSPORT_NUMBER BIOMETRIC_ID COOKIE_ID DEVICE_ID LOCATION FINANCIAL_ACCOUNT CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER HEALTH_INSURANCE_ID DIAGNOSIS RELIGION ETHNICITY POLITICAL_OPINION",
    "nzpa": "PERSON_NAME EMAIL_ADDRESS PHONE_NUMBER IP_ADDRESS POSTAL_ADDRESS DATE_OF_BIRTH NATIONAL_ID BIOMETRIC_ID HEALTH_INSURANCE_ID DIAGNOSIS COOKIE_ID DEVICE_ID LOCATION FINANCIAL_ACCOUNT CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER RELIGION ETHNICITY POLITICAL_OPINION SEXUAL_ORIENTATION",
    "australia_pa": "PERSON_NAME EMAIL_ADDRESS PHONE_NUMBER IP_ADDRESS POSTAL_ADDRESS DATE_OF_BIRTH NATIONAL_ID BIOMETRIC_ID HEALTH_INSURANCE_ID DIAGNOSIS COOKIE_ID DEVICE_ID LOCATION FINANCIAL_ACCOUNT CREDIT_CARD_NUMBER BANK_ACCOUNT_NUMBER RELIGION ETHNICITY POLITICAL_OPINION SEXUAL_ORIENTATION",
}
PACK_TYPES: dict[str, tuple[str, ...]] = {pack: tuple(types.split()) for pack, types in _TYPES.items()}
#: Which of two overlapping identifiers wins; types not listed have 50.
PRIORITY = {
    "CREDIT_CARD_NUMBER": 100, "IBAN": 100, "CPF": 95, "NATIONAL_ID": 95, "SOCIAL_SECURITY_NUMBER": 95, "HEALTH_INSURANCE_ID": 90, "MEDICAL_RECORD_NUMBER": 90,
    "PASSPORT_NUMBER": 90, "TAX_ID": 85, "DRIVERS_LICENSE": 80, "LICENSE_PLATE": 75, "PHONE_NUMBER": 70,
}
#: Types whose spans give way to an overlapping span of the type on the left.
ABSORBS = {"ORGANIZATION_NAME": ("LOCATION",), "POSTAL_ADDRESS": ("LOCATION", "STREET_ADDRESS"), "STREET_ADDRESS": ("LOCATION",)}
#: Types found under another name, and types that another one covers.
ALIASES = {"CREDIT_CARD_NUMBER": "CREDIT_CARD", "IBAN": "IBAN_CODE"}
PARENTS = {"FIRST_NAME": "PERSON_NAME", "LAST_NAME": "PERSON_NAME", "CITY": "LOCATION", "STREET_ADDRESS": "POSTAL_ADDRESS", "BANK_ACCOUNT_NUMBER": "IBAN", "FINANCIAL_ACCOUNT": "CREDIT_CARD_NUMBER"}
CONTEXTUAL = ("DIAGNOSIS", "MEDICATION", "CLINICAL_NOTE", "POLITICAL_OPINION", "RELIGION", "ETHNICITY", "SEXUAL_ORIENTATION", "BIOMETRIC_ID", "DNA_PROFILE")
MODEL_TYPES = ("PERSON_NAME", "FIRST_NAME", "LAST_NAME", "LOCATION", "ORGANIZATION_NAME")
PERSON_TYPES = ("PERSON_NAME", "FIRST_NAME", "LAST_NAME", "ALIAS", "USERNAME")
# --- end of fixed values ---------------------------------------------------------------------------


def catalogue(ids: str | None = None) -> list[str]:
    """Pack names of a comma-separated list, in catalogue order; all of them for a blank one."""
    asked = {x.strip() for x in (ids or "").split(",") if x.strip()}
    if unknown := asked - set(PACKS):
        raise ValueError(f"unknown packs: {sorted(unknown)}")
    return [p for p in PACKS if not asked or p in asked]


def types_of(packs: Iterable[str]) -> list[str]:
    return sorted({t for p in packs for t in PACK_TYPES[p]})


def alike(rule: Rule) -> Rule:
    """The rule without its names: equal for rules that find the same."""
    return replace(rule, name="", pack="")


def distinct(rules: Iterable[Rule]) -> list[Rule]:
    """Rules without those that find just what an earlier one finds, whatever their names."""
    seen, out = set(), []
    for r in rules:
        key = alike(r)
        if key not in seen:
            seen.add(key)
            out.append(r)
    return out


@dataclass(frozen=True)
class Custom:
    """A rule of the user's own. method: regex, keyword_list or llm_prompt."""

    name: str
    entity_type: str
    method: str
    pattern: str | None = None
    keywords: tuple[str, ...] = ()
    active: bool = True


def from_custom(custom: Iterable[Custom], prompt_rule=None) -> list[Rule]:
    """Rules of active custom rows. An invalid pattern is left out, and a prompt without ``prompt_rule`` to turn it into a rule."""
    out = []
    for c in custom:
        if not c.active:
            continue
        if c.method == "regex" and c.pattern:
            try:
                re.compile(c.pattern)
            except re.error:
                continue
            out.append(Rule(c.name, "custom", c.entity_type, c.pattern, 0.6, ignore_case=True))
        elif c.method == "keyword_list" and c.keywords:
            words = "|".join(map(re.escape, c.keywords))
            out.append(Rule(c.name, "custom", c.entity_type, rf"\b(?:{words})\b", 0.7, ignore_case=True))
        elif c.method == "llm_prompt" and prompt_rule is not None:
            out.append(prompt_rule(c))
    return out


@dataclass(frozen=True)
class Policy:
    packs: tuple[str, ...]
    types: tuple[str, ...]
    rules: tuple[Rule, ...]


def compose(packs: Iterable[str] = (), custom: Iterable[Custom] = (), baseline: bool = True) -> Policy:
    """The union of the packs' types and rules, with custom and baseline rules; each rule once."""
    packs = tuple(packs)
    own = from_custom(custom)
    rules = distinct([*(r for p in packs for r in PACKS[p]), *own, *(BASELINE if baseline else ())])
    return Policy(packs, tuple(sorted({*types_of(packs), *(r.entity_type for r in own)})), tuple(rules))


def expand_types(types: Iterable[str]) -> set[str]:
    """The types with the names and parents under which they are found as well."""
    types = set(types)
    return types | {ALIASES[t] for t in types if t in ALIASES} | {PARENTS[t] for t in types if t in PARENTS}


def uncovered(policy: Policy) -> list[str]:
    """Types of the policy that no rule finds, nor a model, nor a rule for the type that covers them."""
    found = {r.entity_type for r in policy.rules} | set(MODEL_TYPES) | set(CONTEXTUAL)
    return sorted(t for t in policy.types if t not in found and PARENTS.get(t) not in found)
