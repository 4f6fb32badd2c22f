"""Deterministic encryption, tags and keys.

AES-CBC with the initial vector taken from the content hash: equal plaintexts give equal ciphertexts, so encrypted data
still deduplicates. Unlike XTS it isn't length-preserving: the vector and padding add 17 to 32 bytes. Keys reach executors inside
closures and never as a column or a literal of a plan.
"""

from __future__ import annotations

import hashlib
import hmac
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import EncryptionError

KEY_ENV = "QUARRY_MASTER_KEY"
TAG_BYTES = 16


def hkdf(master: bytes, context: bytes, length: int = 64) -> bytes:
    """HKDF with HMAC-SHA256; the salt is bound to the master key."""
    salt = hashlib.sha256(b"QUARRY-SALT-V1" + master).digest()
    prk = hmac.new(salt, master, hashlib.sha256).digest()
    out, block, n = b"", b"", 1
    while len(out) < length:
        block = hmac.new(prk, block + context + bytes([n]), hashlib.sha256).digest()
        out, n = out + block, n + 1
    return out[:length]


class KeyRing:
    """Versions of a key pair derived from one master key. The current version encrypts; every version decrypts."""

    def __init__(self, master: bytes):
        if len(master) != 32:
            raise EncryptionError("the master key must have 32 bytes")
        self._master, self.current, self._rotating = master, 1, False
        self._cache: dict[int, tuple[bytes, bytes]] = {}

    @classmethod
    def from_env(cls, name: str = KEY_ENV) -> KeyRing:
        """The key in hex from the environment; without one this raises, so nothing is ever stored in the clear by mistake."""
        text = os.environ.get(name)
        if not text:
            raise EncryptionError(f"{name} isn't set")
        try:
            return cls(bytes.fromhex(text))
        except ValueError as e:
            raise EncryptionError(f"{name} isn't hex") from e

    @classmethod
    def from_provider(cls, provider: Callable[[], bytes], salt: bytes = b"") -> KeyRing:
        """The key from a device or a vault, mixed with an optional salt."""
        secret = provider()
        return cls(hashlib.sha256(secret + salt).digest() if salt else secret)

    def get(self, version: int) -> tuple[bytes, bytes]:
        if not 1 <= version <= self.current:
            raise EncryptionError(f"no key version {version}")
        if version not in self._cache:
            pair = hkdf(self._master, b"quarry-xts" + version.to_bytes(4, "big"))
            self._cache[version] = pair[:32], pair[32:]
        return self._cache[version]

    def rotate(self) -> int:
        if self._rotating:
            raise EncryptionError("a rotation is under way")
        self._rotating, self.current = True, self.current + 1
        return self.current

    def complete(self) -> None:
        self._rotating = False

    def versions(self) -> list[int]:
        return sorted({*self._cache, self.current})

    def clear(self) -> None:
        self._cache.clear()

    def pairs(self) -> dict[int, tuple[bytes, bytes]]:
        return {v: self.get(v) for v in range(1, self.current + 1)}


def tweak(content_hash: Column) -> Column:
    """The first 16 bytes of a hex hash, padded with zeros."""
    raw = F.unhex(content_hash)
    return F.rpad(F.substring(raw, 1, 16), F.lit(16), F.lit(bytearray(b"\0")))


def encrypt(data: Column, key: Column, content_hash: Column) -> Column:
    """``data`` under ``key`` (32 bytes), in the JVM. Null stays null; empty data is encrypted too."""
    return F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), tweak(content_hash))


def sealed_length(length: Column) -> Column:
    """How long ``encrypt`` makes data of ``length`` bytes: the vector, and one to 16 bytes that fill the last block."""
    return (16 + (F.floor(length / 16) + 1) * 16).cast("bigint")


def decrypt(data: Column, key: Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("CBC"), F.lit("PKCS"))


def _tag(key: bytes, data: bytes, version: int, key_version: int, iv: bytes) -> bytes:
    tail = version.to_bytes(2, "little") + key_version.to_bytes(4, "little") + iv + len(data).to_bytes(4, "little")
    return hmac.new(key, data + tail, hashlib.sha256).digest()[:TAG_BYTES]


def mac_udf(ring: KeyRing):
    """An Arrow function (ciphertext, format version, key version, tweak) -> 16-byte tag."""
    keys = {v: hashlib.sha256(b"QUARRY-MAC" + a + b).digest() for v, (a, b) in ring.pairs().items()}

    @F.arrow_udf(T.BinaryType())
    def mac(data: pa.Array, version: pa.Array, key_version: pa.Array, iv: pa.Array) -> pa.Array:
        return pa.array([None if d is None else _tag(keys[k], d, v, k, i) for d, v, k, i in zip(*(x.to_pylist() for x in (data, version, key_version, iv)))], pa.binary())

    return mac


def verify_udf(ring: KeyRing):
    """An Arrow function (ciphertext, format version, key version, tweak, tag) -> whether the tag is right, compared in constant time."""
    keys = {v: hashlib.sha256(b"QUARRY-MAC" + a + b).digest() for v, (a, b) in ring.pairs().items()}

    @F.arrow_udf(T.BooleanType())
    def verify(data: pa.Array, version: pa.Array, key_version: pa.Array, iv: pa.Array, tag: pa.Array) -> pa.Array:
        return pa.array([k in keys and t is not None and hmac.compare_digest(_tag(keys[k], d, v, k, i), t) for d, v, k, i, t in zip(*(x.to_pylist() for x in (data, version, key_version, iv, tag)))], pa.bool_())

    return verify


def keyed(ring: KeyRing) -> Callable[[Column], Column]:
    """key_version -> key column for the JVM's AES, by a Python function: plans and logs show a function, not a key."""
    keys = {v: a for v, (a, _) in ring.pairs().items()}

    @F.arrow_udf(T.BinaryType())
    def key_of(version: pa.Array) -> pa.Array:
        return pa.array([keys.get(v) for v in version.to_pylist()], pa.binary())

    return key_of
