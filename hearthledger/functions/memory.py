"""Column functions of the memory model; all but record_key stay inside Spark's generated code."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Han characters that carry no meaning of their own in a query.
STOP_CHARS = list("的了在是和与及要什么怎样吗呢啊今天当前这那个一些有无我你他她它们就都又很")
HAN = r"\p{IsHan}+"
# Lower bounds of the levels of a memory's strength.
LEVELS = {"exact": 85, "clear": 65, "gist": 45, "fragment": 25}
GRAPH_KINDS = "relationship location world_rule goal commitment event".split()  # fixed values
MUTABLE_KINDS = ["state", "location"]  # fixed values: all other kinds only grow
CONFIDENT = 0.75
MONTH = 2_592_000_000.0  # ms


def tokens(text: Column) -> Column:
    """Search tokens: Latin words of two characters or more, Han characters but for stop characters, and Han pairs."""
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit("[a-z0-9_:-]{2,}"), F.lit(0))
    ok = lambda c: ~c.isin(STOP_CHARS)
    runs = F.transform(F.regexp_extract_all(low, F.lit(HAN), F.lit(0)), lambda run: F.filter(F.split(run, ""), lambda c: c != ""))
    ones = F.flatten(F.transform(runs, lambda cs: F.filter(cs, ok)))
    pairs = F.flatten(
        F.transform(
            runs,
            lambda cs: F.transform(
                F.filter(F.arrays_zip(F.slice(cs, 1, F.greatest(F.size(cs) - 1, F.lit(0))).alias("a"), F.slice(cs, 2, F.greatest(F.size(cs) - 1, F.lit(0))).alias("b")), lambda p: ok(p["a"]) & ok(p["b"])),
                lambda p: F.concat(p["a"], p["b"]),
            ),
        )
    )
    return F.when(F.regexp_like(low, F.lit(HAN)), F.concat(latin, ones, pairs)).otherwise(latin)


def key_part(value: Column) -> Column:
    """Trimmed, white space collapsed (as Unicode has it), lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(value, r"(?U)\s+", " "), "^ | $", ""))


def canonical_key(*parts: Column) -> Column:
    return F.concat_ws("::", *(key_part(p) for p in parts))


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over code points, as a whole number; code points are read from UTF-32."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "utf-32")), F.lit("[0-9A-F]{8}"), F.lit(0))
    step = lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.aggregate(units, F.lit(2166136261).cast("long"), step)


def _advanced(texts: list[str], h: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """FNV-1a from states `h` (a row for each text, a column for each variant); every code point is first crossed with `mask`.  All texts advance together."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    by = np.argsort(-lengths, kind="stable")
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = (np.cumsum(lengths) - lengths)[by]
    longest = int(lengths.max(initial=0))
    for t, live in enumerate(np.searchsorted(-lengths[by], -np.arange(longest), "left").tolist()):
        now = h[:live]
        now ^= codes[starts[:live] + t][:, None] ^ mask
        now *= np.uint32(16777619)
    out = np.empty_like(h)
    out[by] = h
    return out


def fnv1a_variants(texts: list[str], variants: int = 4) -> np.ndarray:
    """FNV-1a of 32 bits over the code points of variant, NUL and text: a row for each text, a column for each variant."""
    prime = np.uint32(16777619)
    h = np.full((len(texts), variants), 2166136261, dtype=np.uint32)
    h ^= np.array([ord(str(v)) for v in range(variants)], dtype=np.uint32)
    h *= prime
    h *= prime  # NUL changes no bit
    return _advanced(texts, h, np.zeros(variants, dtype=np.uint32))


def stable_hashes(texts: list[str]) -> list[str]:
    """128 bits as 32 hex digits: four FNV-1a hashes whose code points are crossed with 0, 1, 2 and 3."""
    h = np.full((len(texts), 4), 2166136261, dtype=np.uint32)
    return ["".join(f"{x:08x}" for x in row) for row in _advanced(texts, h, np.arange(4, dtype=np.uint32)).tolist()]


def record_key(text: Column) -> Column:
    """128 bits as 32 hex digits: FNV-1a of four variants over the NFKC form; null stays null."""

    @F.pandas_udf("string")
    def key(texts: pd.Series) -> pd.Series:
        import unicodedata

        known = texts.dropna()
        plain = [unicodedata.normalize("NFKC", t) for t in known]
        sizes = np.cumsum([len(t) for t in plain])
        made, at = [], 0
        while at < len(plain):  # about 4 million code points at once
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (4 << 20), "right")))
            made += ["".join(f"{x:08x}" for x in row) for row in fnv1a_variants(plain[at:end]).tolist()]
            at = end
        return pd.Series(made, index=known.index, dtype=object).reindex(texts.index, fill_value=None)

    return key(text)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def effective_strength(strength, clarity, salience, rehearsals, last, now: int, tau: float = MONTH, gain: float = 0.04, emotion: float = 0.15, interference: float = 0.0, cue: float | Column = 1.0) -> Column:
    """Strength left at `now`: it decays by e every `tau` ms; rehearsal and emotion hold it up; `cue` tells how well it is cued."""
    decay = F.exp(-F.greatest(F.lit(0), F.lit(now) - last) / F.lit(tau))
    raw = strength * decay * (1 + F.greatest(rehearsals, F.lit(0)) * gain) * (1 + clamp(salience, 0.0, 1.0) * emotion) * (clamp(clarity, 0.0, 100.0) / 100) * clamp(F.lit(cue), 0.0, 1.0)
    return clamp(raw - F.lit(max(0.0, interference)), 0.0, 100.0)


def level(strength: Column) -> Column:
    out = F.lit("forgotten")
    for name, least in sorted(LEVELS.items(), key=lambda x: x[1]):
        out = F.when(strength >= least, name).otherwise(out)
    return out


# How near a fact's kind is to a requested kind, the first that holds.
AFFINITY = [("event", "commitment", 0.45), ("event", "goal", 0.45), ("capability", "state", 0.35), ("state", "location", 0.8), ("state", "capability", 0.25), ("relationship", "identity", 0.25)]


def kind_affinity(kind: Column, requested: list[str]) -> Column:
    want = {r.strip().lower() for r in requested if r.strip()}
    out = F.lit(0.0)
    for asked, has, worth in reversed(AFFINITY):
        if asked in want:
            out = F.when(kind == has, F.lit(worth)).otherwise(out)
    return F.when(kind.isin(sorted(want)), F.lit(1.0)).otherwise(out) if want else F.lit(0.0)
