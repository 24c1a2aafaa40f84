"""Security of columns by their flags, and conversion of types for a target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import _secure_hash, decrypt, encrypt

FLAGS = ("none", "fast_encrypt", "fast_decrypt", "fast_encrypted", "strong_encrypt", "strong_decrypt", "strong_encrypted", "one_way_hash", "one_way_hashed", "hide")
ROUNDS = {"fast": 5, "strong": 1000}


def flag(df: DataFrame, **flags: str) -> DataFrame:
    """Marks columns with a security flag, kept in their metadata."""
    return df.withColumns({c: F.col(c).alias(c, metadata=df.schema[c].metadata | {"security": f}) for c, f in flags.items()})


def secure(df: DataFrame, key: str = "", mode: str = "encrypt_decrypt") -> DataFrame:
    """Applies the flags: encrypt_decrypt encrypts, decrypts and hashes; mask puts (Encrypted), (Hashed), (Hidden) in place of protected values."""
    out = {}
    for f in df.schema.fields:
        kind = f.metadata.get("security", "none")
        x = F.col(f"`{f.name}`")
        if kind == "hide":
            out[f.name] = F.lit("(Hidden)")
        elif mode == "mask" and kind != "none":
            out[f.name] = F.lit("(Hashed)" if kind.startswith("one_way") else "(Encrypted)")
        elif kind in ("fast_encrypt", "strong_encrypt"):
            out[f.name] = encrypt(x.cast("string"), key, ROUNDS[kind.split("_")[0]])
        elif kind in ("fast_decrypt", "strong_decrypt"):
            out[f.name] = decrypt(x, key, ROUNDS[kind.split("_")[0]])
        elif kind == "one_way_hash":
            out[f.name] = _secure_hash(x.cast("string"))
    return df.withColumns(out)


def coerce(df: DataFrame, arrays: bool = True, binary: bool = True, booleans: bool = True, nodes: bool = True, bytes_: bool = True) -> DataFrame:
    """Types that a target can't hold become ones that it can: JSON text, base64, 0 and 1, small integers."""
    out = {}
    for f in df.schema.fields:
        x, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.ArrayType) and not arrays or isinstance(t, (T.StructType, T.MapType)) and not nodes:
            out[f.name] = F.to_json(x)
        elif isinstance(t, T.BinaryType) and not binary:
            out[f.name] = F.base64(x)
        elif isinstance(t, T.BooleanType) and not booleans:
            out[f.name] = x.cast("int")
        elif isinstance(t, T.ByteType) and not bytes_:
            out[f.name] = x.cast("short")
    return df.withColumns(out) if out else df
