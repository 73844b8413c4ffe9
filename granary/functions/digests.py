"""Digests, keyed digests, symmetric encryption and name-based UUIDs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Well-known namespaces of name-based UUIDs (fixed values).
NAMESPACES = {
    "dns": "6ba7b810-9dad-11d1-80b4-00c04fd430c8",
    "url": "6ba7b811-9dad-11d1-80b4-00c04fd430c8",
    "oid": "6ba7b812-9dad-11d1-80b4-00c04fd430c8",
    "x500": "6ba7b814-9dad-11d1-80b4-00c04fd430c8",
}


def digest(data: Column, kind: str) -> Column:
    """Digest as hexadecimal text: md5, sha1, sha224, sha256, sha384 or sha512."""
    binary = data.cast("binary")
    if kind == "md5":
        return F.md5(binary)
    return F.sha1(binary) if kind == "sha1" else F.sha2(binary, int(kind[3:]))


def hmac(data: Column, key: bytes, kind: str) -> Column:
    """Keyed digest (RFC 2104) as hexadecimal text, for a key known to the caller."""
    import hashlib

    block = 128 if kind in ("sha384", "sha512") else 64
    if len(key) > block:
        key = hashlib.new(kind, key).digest()
    key = key.ljust(block, b"\0")
    inner = digest(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), data.cast("binary")), kind)
    return digest(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), kind)


def encrypt(data: Column, key: Column) -> Column:
    return F.aes_encrypt(data.cast("binary"), key.cast("binary"))


def decrypt(data: Column, key: Column) -> Column:
    return F.aes_decrypt(data, key.cast("binary")).cast("string")


def uuid_of_name(namespace: str, name: Column, version: int = 5) -> Column:
    """Version 3 (md5) or 5 (sha1) UUID of a name in a namespace given by its short name or as a UUID."""
    space = bytes.fromhex(NAMESPACES.get(namespace, namespace).replace("-", ""))
    whole = F.concat(F.lit(space), name.cast("binary"))
    h = F.md5(whole) if version == 3 else F.substring(F.sha1(whole), 1, 32)
    variant = F.lower(F.conv(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8, 10, 16))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit(str(version)), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
