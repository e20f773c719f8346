from cohorta.functions.coerce import (  # noqa: F401
    blank_to_null, email_domain, epoch_or_timestamp, like_escape, safe_cast, safe_int,
)
