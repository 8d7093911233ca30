"""Fixed values that decide results: kinds, alias lists, keywords, patterns, tables."""

# --- fixed values -----------------------------------------------------------
# These lists, patterns and tables are part of the data contract. They are kept
# together, as plain text and in their natural order.

KINDS = ["personal", "location", "professional", "bank", "net"]

# Winner order when two kinds score the same.
TIE_ORDER = ["bank", "professional", "personal", "location", "net"]

IDENTIFIERS = ["passport", "email", "phone", "tax_id", "ssn"]

ALIASES = {
    "personal": {
        "fullname": ["fullname", "full_name", "name"],
        "first_name": ["first_name", "firstname", "given_name", "givenname"],
        "last_name": ["last_name", "lastname", "surname", "family_name", "familyname"],
        "email": ["email", "personal_email", "work_email", "mail", "correo"],
        "phone": ["phone", "mobile", "phone_number", "tel", "telefono"],
        "dob": ["dob", "birthdate", "date_of_birth", "fecha_nacimiento"],
    },
    "location": {
        "address": ["address", "street_address", "direccion", "dirección", "addr", "calle"],
        "city": ["city", "ciudad", "locality", "town"],
        "state": ["state", "province", "provincia", "region"],
        "postal_code": ["postal_code", "zip", "zipcode", "cp", "codigo_postal"],
        "country": ["country", "pais", "país", "country_name"],
        "latitude": ["latitude", "lat"],
        "longitude": ["longitude", "lon", "lng", "long"],
    },
    "professional": {
        "company": ["company", "empresa", "employer"],
        "position": ["position", "job_title", "role", "puesto", "cargo"],
        "department": ["department", "dept", "departamento"],
        "salary": ["salary", "salario", "compensation"],
        "contract_type": ["contract_type", "tipo_contrato"],
        "experience_years": ["experience_years", "anos_experiencia", "años_experiencia"],
    },
    "bank": {
        "iban": ["iban", "iban_code", "iban_number", "ibannumber", "ibannum"],
        "swift": ["swift", "swift_code", "bic", "bic_code"],
        "account_number": ["account_number", "account", "acct", "n_cuenta", "numero_cuenta", "accountnumber"],
        "bank_name": ["bank_name", "bank", "banco"],
        "card_number": ["card_number", "tarjeta", "num_tarjeta", "cardnumber"],
        "card_brand": ["card_brand", "brand", "marca_tarjeta"],
        "card_exp": ["card_exp", "expiry", "exp", "exp_date", "expiration"],
        "card_holder": ["card_holder", "holder", "titular"],
    },
    "net": {
        "ipv4": ["ipv4", "ip", "ip_address"],
        "ipv6": ["ipv6"],
        "mac": ["mac", "mac_address"],
        "hostname": ["hostname", "host"],
        "domain": ["domain", "email_domain"],
        "url": ["url", "link"],
        "ssid": ["ssid", "wifi_ssid"],
        "user_agent": ["user_agent", "agent", "ua"],
        "browser": ["browser", "navegador"],
        "os": ["os", "so", "operating_system"],
    },
}

IDENTIFIER_ALIASES = {
    "passport": ["passport", "id_document", "dni", "nif"],
    "email": ["email", "personal_email", "work_email", "mail", "correo"],
    "phone": ["phone", "mobile", "phone_number", "tel", "telefono"],
    "tax_id": ["tax_id", "nif", "nie", "ssn"],
    "ssn": ["ssn"],
}

FULLNAME_ALIASES = ["fullname", "full_name", "name"]
BIRTH_ALIASES = ["dob", "birthdate", "date_of_birth", "fecha_nacimiento"]

# Substrings looked for in lower-cased string values (never in keys).
KEYWORDS = {
    "bank": ["iban", "swift", "bic", "bank", "account"],
    "professional": ["company", "position", "role", "department", "job", "empresa", "puesto"],
    "net": ["ip", "ipv4", "ipv6", "mac", "hostname", "domain", "url", "ssid", "browser", "user-agent", "user agent"],
    "location": ["address", "city", "postal", "zipcode", "zip", "country", "latitude", "longitude", "coords", "street",
                 "calle", "ciudad", "cp", "provincia", "pais", "dirección", "direccion"],
    "personal": ["name", "fullname", "first name", "last name", "surname", "email", "phone", "birth", "nombre",
                 "apellido", "correo", "teléfono", "telefono", "fecha de nacimiento"],
}

# Regular expressions with Unicode word boundaries and digits.
IBAN_PATTERN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"
SWIFT_PATTERN = r"\b[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?\b"
IPV4_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6_PATTERN = r"\b[0-9a-f:]{2,}\b"

# What counts as white space when text is normalised.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

FREE_MAIL_DOMAINS = [
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.es", "ymail.com",
    "hotmail.com", "live.com", "outlook.com", "icloud.com", "me.com",
    "aol.com", "proton.me", "protonmail.com", "mail.com", "gmx.com",
    "gmx.es", "yandex.ru", "yandex.com", "tutanota.com", "zoho.com",
    "qq.com", "163.com", "126.com", "wanadoo.fr", "orange.fr", "libero.it",
]

# Domain parts that never name a company.
DOMAIN_PREFIXES = ["www", "mail"]

IBAN_COUNTRIES = {
    "ES": "Spain", "IT": "Italy", "FR": "France", "DE": "Germany", "PT": "Portugal",
    "NL": "Netherlands", "BE": "Belgium", "GB": "United Kingdom", "IE": "Ireland",
    "SE": "Sweden", "NO": "Norway", "FI": "Finland", "DK": "Denmark", "CH": "Switzerland",
    "PL": "Poland", "CZ": "Czech Republic", "AT": "Austria",
}

# Typed records: output column -> message key.
RECORD_FIELDS = {
    "personal": {"name": "name", "last_name": "last_name", "sex": "sex", "telfnumber": "telfnumber",
                 "passport": "passport", "email": "email"},
    "location": {"fullname": "fullname", "city": "city", "address": "address"},
    "professional": {"fullname": "fullname", "company": "company", "company_address": "company address",
                     "company_telfnumber": "company_telfnumber", "company_email": "company_email", "job": "job"},
    "bank": {"passport": "passport", "IBAN": "IBAN", "salary": "salary"},
    "net": {"address": "address", "IPv4": "IPv4"},
}

# Exact-key rules in order: kind, keys that must be there, key that must not.
EXACT_KEY_RULES = [
    ("personal", ["name", "last_name", "sex"], None),
    ("location", ["fullname", "city", "address"], "company"),
    ("professional", ["fullname", "company", "job"], None),
    ("bank", ["passport", "IBAN", "salary"], None),
    ("net", ["IPv4", "address"], None),
]

CHILD_TABLES = {
    "personal": "personal_data",
    "location": "location_data",
    "professional": "professional_data",
    "bank": "bank_data",
    "net": "net_data",
}
# --- end of fixed values ----------------------------------------------------
