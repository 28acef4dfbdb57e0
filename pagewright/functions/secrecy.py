"""Protected texts and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of key names whose values are never logged.
SENSITIVE = ("token", "secret", "password", "authorization", "cookie", "signature", "header")


def protect(text: Column, key: Column) -> Column:
    """AES-256-GCM and the text's hash."""
    return F.struct(F.aes_encrypt(text, key, F.lit("GCM")).alias("cipher"), F.sha2(text, 256).alias("sha256"))


def reveal(protected: Column, key: Column) -> Column:
    """The text, or null if it can't be decrypted or isn't the one that was hashed."""
    plain = F.try_aes_decrypt(protected["cipher"], key, F.lit("GCM")).cast("string")
    return F.when(F.sha2(plain, 256) == protected["sha256"], plain)


def redact(metadata: Column) -> Column:
    """A map without its sensitive keys."""
    return F.map_filter(metadata, lambda k, _: ~F.lower(k).rlike("|".join(SENSITIVE)))
