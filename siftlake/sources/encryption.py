"""Keys of encrypted Parquet files: normalising, options, detection.

Spark decrypts through a key-management client on the JVM class path, named
by ``parquet.encryption.kms.client.class``; keys themselves can't be handed
over from Python. The settings here become Hadoop options of the read; with
keys but without a client an error says so, and so does an AAD prefix, for
which that reader has no setting.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from siftlake.plans.cache import identity
from siftlake.sources import scan

_SIZES = (16, 24, 32)


def normalise_key(text: str) -> bytes:
    """An AES key from UTF-8, hexadecimal or base64 text of a key's size, else the text's SHA-256."""
    raw = text.encode()
    if len(raw) in _SIZES:
        return raw
    try:
        if len(h := bytes.fromhex(text)) in _SIZES:
            return h
    except ValueError:
        pass
    try:
        if len(b := base64.b64decode(text, validate=True)) in _SIZES:
            return b
    except (binascii.Error, ValueError):
        pass
    return hashlib.sha256(raw).digest()


def is_encrypted_footer(path: str) -> bool:
    """Whether the file ends in the mark of an encrypted footer."""
    with scan.opened(path) as f:
        f.seek(-4, 2)
        return f.read(4) == b"PARE"


@dataclass(frozen=True)
class Encryption:
    footer_key: str | None = None
    footer_signing_key: str | None = None
    plaintext_footer: bool = False
    aad_prefix: str | None = None
    aad_out_of_band: bool = False
    ctr_variant: bool = False
    column_key: Callable[[str], str | None] | None = None

    @property
    def wanted(self) -> bool:
        return bool(self.footer_key or self.footer_signing_key or self.column_key or self.aad_prefix)

    def options(self, columns: list[str] = ()) -> dict[str, str]:
        """Settings of the properties-driven crypto factory; keys are names that the client resolves."""
        out = {"parquet.crypto.factory.class": "org.apache.parquet.crypto.keytools.PropertiesDrivenCryptoFactory"} if self.wanted else {}
        if key := self.footer_key or self.footer_signing_key:
            out["parquet.encryption.footer.key"] = key
        if self.plaintext_footer or self.footer_signing_key:
            out["parquet.encryption.plaintext.footer"] = "true"
        if self.ctr_variant:
            out["parquet.encryption.algorithm"] = "AES_GCM_CTR_V1"
        if self.column_key:
            by_key: dict[str, list[str]] = {}
            for c in columns:
                if k := self.column_key(c):
                    by_key.setdefault(k, []).append(c)
            if by_key:
                out["parquet.encryption.column.keys"] = ";".join(f"{k}:{','.join(v)}" for k, v in by_key.items())
        return out

    def fingerprint(self) -> str:
        parts = (self.footer_key, self.footer_signing_key, self.plaintext_footer, self.aad_prefix, self.aad_out_of_band, self.ctr_variant, identity(self.column_key) if self.column_key else None)
        return hashlib.sha256(repr(parts).encode()).hexdigest()

    def require_client(self, spark) -> None:
        if self.aad_prefix:
            raise RuntimeError("Spark's Parquet reader can't be given an AAD prefix: its key-management factory has no setting for one")
        conf = spark._jsc.hadoopConfiguration()
        if self.wanted and not conf.get("parquet.encryption.kms.client.class"):
            raise RuntimeError("encrypted files need a key-management client: set spark.hadoop.parquet.encryption.kms.client.class to a class on the class path")
