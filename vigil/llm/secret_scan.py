"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests singles out.

Patterns give the base spans (`assign`, `access`, `hex`; whole matches, code points, end exclusive).
Every other run of 20 or more token characters is a candidate. Its encoding is inferred from the
characters it uses, and two questions are asked about its values in that alphabet:

* could it be random? Chi-squared uniformity over the alphabet, a runs test about the alphabet's
  middle and lag-1 serial correlation, combined by Fisher's method, must not reject that;
* could it be text? The count of equal character pairs against that of natural language, and
  the changes between lower case, upper case and digits, give a p-value under "text".

Candidates of all documents are sorted into strata of encoding and length, and in each the
Benjamini-Hochberg procedure picks the p-values that keep the false discovery rate: a short token
has to compete with the many short tokens only. Those become spans of kind `random`.

Defined cases: null and empty texts have no spans; each row stands alone, except that repeated
rows count again in their stratum; a token that overlaps a base span is no candidate; decimal
numbers and UUIDs are none either; texts of any length are read whole, in one pass of each pattern; an empty table gives
an empty result. Only id and text are read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm import common

# The patterns and least lengths of the base kinds, in order.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN, ACCESS_MIN = 6, 20

TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets from the narrowest; a token belongs to the first that holds all its characters.
ALPHABETS = {
    "decimal": _DIGITS, "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UPPER + "234567",
    "lower": _LOWER, "lower36": _DIGITS + _LOWER, "upper36": _DIGITS + _UPPER, "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "any": _UPPER + _LOWER + _DIGITS + "+/-_",
}
#: Natural language: chance that two, and that three, random letters of a text are equal.
PAIR, TRIPLE = 0.065, 0.0057
#: Rate at which identifiers in text change between lower case, upper case and digits.
CHANGES = 0.1
#: Level at which the battery rejects randomness; false discovery rate in each stratum.
ALPHA, FDR = 0.001, 0.01
BINS = 400
CANDS = "array<struct<s:int,e:int,stratum:int,bin:int>>"


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared by the Wilson-Hilferty approximation."""
    if x <= 0:
        return 1.0
    v = 2 / (9 * df)
    return _normal_tail(((x / df) ** (1 / 3) - (1 - v)) / math.sqrt(v))


def _fisher(ps: list[float]) -> float:
    """Fisher's combination; the tail of chi-squared with an even number of degrees is a finite sum."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    term = total = 1.0
    for i in range(1, len(ps)):
        term *= half / i
        total += term
    return math.exp(-half) * total


def _binomial_tail(n: int, p: float, least: int) -> float:
    if least <= 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(least, n + 1)]
    return min(1.0, sum(map(math.exp, logs)))


def battery(token: str) -> tuple[str, float, float]:
    """Encoding, p-value under "random in its alphabet", p-value under "text"."""
    body = token.rstrip("=")
    used = set(body)
    name = next(k for k, a in ALPHABETS.items() if used <= set(a))
    alphabet, n = ALPHABETS[name], len(body)
    k = len(alphabet)
    values = np.array([alphabet.index(c) for c in body])
    counts = np.bincount(values, minlength=k)
    uniform = _chi2_tail(k / n * float((counts.astype(float) ** 2).sum()) - n, k - 1)
    high = values >= k // 2
    up = int(high.sum())
    down = n - up
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 2 * up * down / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 0.0
    spread = values.std()
    r = float(((values[:-1] - values.mean()) * (values[1:] - values.mean())).sum() / (n * spread**2)) if spread else 1.0
    p_serial = math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))
    pairs = float((counts * (counts - 1) // 2).sum())
    total = n * (n - 1) / 2
    sd = math.sqrt(total * PAIR * (1 - PAIR) + n * (n - 1) * (n - 2) * max(TRIPLE - PAIR**2, 0))
    p_pairs = _normal_tail(-(pairs + 0.5 - total * PAIR) / sd)
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 for c in body if c.isalnum()]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    p_changes = _binomial_tail(max(len(kinds) - 1, 1), CHANGES, changes)
    return name, _fisher([uniform, p_runs, p_serial]), _fisher([p_pairs, p_changes])


def _stratum(name: str, length: int) -> int:
    """Encoding and length class (two classes per doubling) in one number."""
    return list(ALPHABETS).index(name) * 1000 + int(2 * math.log2(length))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, bin); the bin is the floor of -10 log10 of the p-value under "text"; 0: not random."""
    out = []
    for m in TOKEN.finditer(text):
        s, e = m.span()
        body = m.group().rstrip("=")
        if not body or UUID.fullmatch(body) or body.isdigit() or any(a < e and s < b for a, _, b in base):
            continue
        name, p_random, p_text = battery(body)
        bin_ = 0 if p_random < ALPHA else min(BINS, int(-10 * math.log10(max(p_text, 1e-300))))
        out.append((s, e, _stratum(name, len(body)), bin_))
    return out


def _tokens_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("s", "k", "e")]))
        cand = pa.list_(pa.struct([(n, pa.int32()) for n in ("s", "e", "stratum", "bin")]))
        for batch in batches:
            base, more = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                own = base_spans(text)
                base.append([{"s": s, "k": k, "e": e} for s, k, e in own])
                more.append([{"s": s, "e": e, "stratum": t, "bin": b} for s, e, t, b in candidates(text, own)])
            yield pa.record_batch([batch.column(0), pa.array(base, kind), pa.array(more, cand)], ["doc_id", "base", "cands"])

    return common.id_text(docs, id_col, text_col).mapInArrow(
        run, f"doc_id long, base array<struct<s:int,k:int,e:int>>, cands {CANDS}"
    )


def thresholds(tokens: DataFrame, fdr: float = FDR) -> DataFrame:
    """stratum, bin: the least bin that Benjamini-Hochberg accepts, from one histogram over all candidates."""
    counts = tokens.select(F.explode("cands").alias("c")).groupBy("c.stratum", "c.bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy("stratum")
    ranked = counts.withColumn("m", F.sum("n").over(by)).withColumn(
        "r", F.sum("n").over(by.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    )
    good = ranked.where((F.col("bin") > 0) & (F.col("m") * F.pow(F.lit(10.0), -F.col("bin") / 10) <= fdr * F.col("r")))
    return good.groupBy("stratum").agg(F.min("bin").alias("bin"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """doc_id, spans array<struct<s, k, e>>: base and random spans by start and kind (index in KINDS)."""
    tokens = common.materialize(_tokens_of(docs, id_col, text_col), "secrets")
    # at most a row for each alphabet and length class
    least = {r["stratum"]: r["bin"] for r in thresholds(tokens, fdr).collect()}
    if least:
        limit = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
        taken = F.filter("cands", lambda c: c["bin"] >= F.coalesce(F.element_at(limit, c["stratum"]), F.lit(BINS + 1)))
    else:
        taken = F.filter("cands", lambda c: F.lit(False))
    random = F.transform(taken, lambda c: F.struct(c["s"].alias("s"), F.lit(3).alias("k"), c["e"].alias("e")))
    return tokens.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def digests(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        count(3).alias("n_random"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"),
    )
