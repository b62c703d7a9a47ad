"""Patterns of personal data and the labels of model detections. All fixed values."""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    """One pattern: wire category, expression, template, base confidence, validator and context words.

    ``gate`` is a cheap expression that every text with a match also matches.
    """

    category: str
    regex: str
    template: str
    base: float = 1.0
    validator: str | None = None
    words: tuple[str, ...] = ()

    @property
    def gate(self) -> str | None:
        return GATES.get(self.category, "[0-9]")


# Patterns in priority order.
PATTERNS = [
    Pattern("email", r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", "[EMAIL]", words=("email", "mail", "e-mail")),
    Pattern("phone_number", r"(?:\+[1-9]\d{0,2}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9})|(?:\(\d{2,4}\)[-\s]?\d{3,4}[-.\s]?\d{3,4})", "[PHONE]"),
    Pattern("phone_number", r"(?:\+33|0033)[ .-]?[1-9](?:[ .-]?\d{2}){4}", "[PHONE]"),
    Pattern("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}[A-Z0-9]{7,30}\b", "[IBAN:****]", 0.3, "iban", ("iban", "bank", "account", "transfer", "swift")),
    Pattern("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN:****]", 0.4, "ssn", ("social", "security", "ssn", "ssns", "ssid")),
    Pattern("credit_card", r"\b(?:\d[ -]*?){13,16}\b", "[CARD:****]", 0.3, "card", ("credit", "card", "visa", "mastercard", "amex", "discover", "diners", "maestro", "jcb", "cc")),
    Pattern("routing_number", r"\b[0-2]\d{8}\b", "[ROUTING:****]"),
    Pattern("swift_bic", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?\b", "[SWIFT:****]"),
    Pattern("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]", words=("ip", "address", "ipv4", "ipv6")),
    Pattern("ip_address", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "[IP]", words=("ip", "address", "ipv4", "ipv6")),
    Pattern("mac_address", r"\b(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}\b", "[MAC]", words=("mac", "address")),
    Pattern("url", r"""(?i)\bhttps?://[^\s<>"']+""", "[URL]", words=("url", "link", "website", "site")),
    Pattern("passport_number", r"\b[A-Z]\d{8}\b", "[PASSPORT:****]"),
    Pattern("date_of_birth", r"\b(?:0[1-9]|[12]\d|3[01])[/.](?:0[1-9]|1[0-2])[/.](?:19|20)\d{2}\b", "[DOB]"),
    Pattern("crypto_wallet", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", "[WALLET:****]", 0.5, "wallet", ("wallet", "btc", "bitcoin", "crypto", "address")),
    Pattern("medical_record_number", r"(?i)\bMRN[:\s]*\d{6,12}\b", "[MRN:****]"),
    Pattern("tax_id", r"\b\d{2}-\d{7}\b", "[EIN:****]"),
    Pattern("vehicle_vin", r"\b[A-HJ-NPR-Z0-9]{17}\b", "[VIN:****]", 0.5, "vin", ("vin", "chassis", "vehicle")),
    Pattern("api_key", r"""(?i)\b(?:api[_-]?key|apikey|api[_-]?secret)[:\s]*['"]?[a-zA-Z0-9_\-]{20,}['"]?""", "[API_KEY]"),
    Pattern("secret_token", r"""(?i)\b(?:token|secret|password|passwd|pwd)[:\s]*['"]?[^\s'"]{8,}['"]?""", "[SECRET]"),
    Pattern("jwt_token", r"\beyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\b", "[JWT]"),
    Pattern("eu_vat", r"(?i)\b(?:AT|BE|BG|CY|CZ|DE|DK|EE|EL|ES|FI|FR|HR|HU|IE|IT|LT|LU|LV|MT|NL|PL|PT|RO|SE|SI|SK)\d{2,12}\b", "[VAT:****]"),
    Pattern("drivers_license", r"\b[A-Z]\d{7,13}\b", "[LICENSE:****]"),
]

#: What all matches of a category hold, where that is not a digit (null: nothing cheap).
GATES = {"vehicle_vin": "[A-Z0-9]{17}", "email": "@", "url": "(?i)https?://", "jwt_token": "eyJ", "swift_bic": "[A-Z]{6}", "api_key": "(?i)api", "secret_token": "(?i)token|secret|passw|pwd", "mac_address": "[0-9a-fA-F]{2}[:-]", "ip_address": "[0-9.:]"}

# Model label (lower case) to category.
ALIASES = {
    "person": "person", "organization": "organization", "location": "address", "email": "email", "phone": "phone_number",
    "phone_number": "phone_number", "url": "url", "ssn": "ssn", "social_security_number": "ssn", "credit_card": "credit_card",
    "creditcard": "credit_card", "iban": "iban", "passport": "passport_number", "passport_number": "passport_number",
    "address": "address", "full_name": "full_name", "fullname": "full_name", "name": "full_name", "first_name": "first_name",
    "middle_name": "middle_name", "last_name": "last_name", "date_of_birth": "date_of_birth", "street_address": "street_address",
    "city": "city", "state_or_region": "state_or_region", "postal_code": "postal_code", "country": "country",
    "government_id": "government_id", "national_id_number": "national_id", "drivers_license_number": "drivers_license",
    "license_number": "drivers_license", "tax_id": "tax_id", "tax_number": "tax_id", "bank_account": "bank_account",
    "account_number": "bank_account", "routing_number": "routing_number", "payment_card": "payment_card",
    "card_number": "credit_card", "card_expiry": "card_expiry", "card_cvv": "card_cvv", "username": "username",
    "ip_address": "ip_address", "password": "password", "secret": "secret_token", "api_key": "api_key", "access_token": "secret_token",
}

# Labels of the business-law taxonomy.
TAXONOMY = [
    "contract_type", "contracting_party", "counterparty_role", "effective_date", "term_length", "renewal_clause",
    "termination_clause", "termination_for_cause", "dispute_resolution_mechanism", "arbitration_clause", "venue",
    "confidentiality_obligation", "non_compete", "non_solicitation", "ip_assignment", "license_grant", "license_scope",
    "liability_cap", "indemnification_clause", "force_majeure", "assignment_clause", "notice_provision", "payment_terms",
    "penalty_clause", "compliance_obligation",
]
