"""Column-expression building blocks (JVM-side, codegen friendly)."""

from lexiflow.functions.text import (  # noqa: F401
    DEFAULT_STOPWORDS, PUNCTUATION, clean_text, clean_tokens, filter_tokens, has_digits,
    has_non_alphanumerics, ngrams, non_alphanumeric_chars, normalize_text, padded_count,
    substring_count, token_count, tokenize,
)
from lexiflow.functions.mathx import ln_beta, ln_gamma  # noqa: F401
from lexiflow.functions.mail import (  # noqa: F401
    address_domain, address_email, address_local, address_name, mail_year, parse_mail_date,
)
