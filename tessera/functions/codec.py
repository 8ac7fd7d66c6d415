"""Seeds, identities, hashes and the float codec."""

from __future__ import annotations

import hashlib
import json
import struct
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNSIGNED = "decimal(20,0)"


#: Fixed value: the namespace of game ids.
GAME_NAMESPACE = uuid.UUID("6ba7b814-9dad-11d1-80b4-00c04fd430c8")
#: What a frame's content id leaves out.
FRAME_DIAGNOSTICS = ("frame_id", "created_at", "mu_bar.norm", "mu_bar.cos_with_axis")


def _unsigned(digest: Column, place: int) -> Column:
    return F.conv(F.substring(digest, place, 16), 16, 10).cast(_UNSIGNED)


def seed_first8(text: Column) -> Column:
    """Unsigned integer of the first eight bytes of SHA-256: board seeds."""
    return _unsigned(F.sha2(text.cast("binary"), 256), 1)


def eight_bytes(number: Column) -> Column:
    """An unsigned integer as eight bytes, the highest first."""
    return F.unhex(F.lpad(F.conv(number.cast("string"), 10, 16), 16, "0"))


def derived_seed(seed: Column, *parts: Column) -> Column:
    """SHA-256 of the seed's eight bytes and the parts (binary), modulo 2 to the 64th."""
    return _unsigned(F.sha2(F.concat(eight_bytes(seed), *parts), 256), 49)


def game_seed(master: Column, game_id: Column) -> Column:
    return derived_seed(master, game_id.cast("binary"))


def engine_seed(game: Column) -> Column:
    return derived_seed(game, F.lit("engine").cast("binary"))


def turn_seed(game: Column, kind: str, seat: Column, turn: Column) -> Column:
    """Seed of a seat's call on a turn; kind: seat (play) or meas (measurement)."""
    return derived_seed(game, F.concat(F.lit(kind), seat.cast("string")).cast("binary"), eight_bytes(turn))


def uuid5(name: Column, namespace: uuid.UUID = GAME_NAMESPACE) -> Column:
    """Name-based identifier, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def encode_f64(values: list[float]) -> str:
    return struct.pack(f">{len(values)}d", *values).hex()


def decode_f64(text: str) -> list[float]:
    raw = bytes.fromhex(text)
    return list(struct.unpack(f">{len(raw) // 8}d", raw))


@F.udf(T.ArrayType(T.DoubleType()))
def decode_f64_column(text: str):
    """Big-endian hexadecimal doubles; Spark has no expression that reads bytes as doubles."""
    return None if text is None else decode_f64(text)


def canonical_json(doc: dict) -> str:
    return json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def _less(doc: dict, without: tuple[str, ...]) -> dict:
    own = {w for w in without if "." not in w}
    inner = {k: tuple(w[len(k) + 1 :] for w in without if w.startswith(k + ".")) for k in doc}
    return {k: _less(v, inner[k]) if inner[k] and isinstance(v, dict) else v for k, v in doc.items() if k not in own}


def content_id(doc: dict, without: tuple[str, ...] = FRAME_DIAGNOSTICS) -> str:
    """SHA-256 of a document's canonical form less some keys; a dot leads into a nested one."""
    return hashlib.sha256(canonical_json(_less(doc, without)).encode()).hexdigest()


def fingerprint(texts: dict[str, str]) -> str:
    """SHA-256 over sorted keys and texts, each ended by a zero byte."""
    return hashlib.sha256("".join(f"{k}\0{texts[k]}\0" for k in sorted(texts)).encode()).hexdigest()

