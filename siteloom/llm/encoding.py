"""Finding and restoring text that was decoded with the wrong encoding (problem 2).

The latent variable of a value is the chain of encodings it went through (often none). For every chain
that could have made the value, the text before it is rebuilt and weighed by a character-pair model
counted over all values. Expectation-maximisation pools that evidence: a prior over chains is estimated
for the corpus and, shrunk towards it, for every source and field; each record is then judged and
repaired by its posterior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.forms import unify
from siteloom.llm.residue import host_of
from siteloom.session import cut_lineage, spread, table

#: Encodings that text is wrongly decoded with, and pairs (wrongly decoded as, written in) of one-byte encodings.
WRONG = ("cp1252", "latin-1", "cp1251", "cp1256", "mac_roman", "cp437", "cp850", "cp1253", "cp1250")
ONE_BYTE = (
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp1256"), ("cp1252", "cp1251"),
    ("cp1251", "cp1252"), ("cp1256", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp1253"), ("cp1252", "cp437"), ("cp1251", "cp1256"), ("cp1256", "cp1251"),
)
#: Steps back up to which encodings that give the same text are told apart; beyond, one of them stands for all, or
#: text misread many times would have a chain for every mixture.
APART = 2
#: Buckets of the character-pair model, smoothing, and characters that it tells apart.
PAIRS, SMOOTH, BACKOFF, ALPHABET = 1 << 20, 0.05, 5.0, 4096
#: Least evidence of a chain in nats, evidence that decides alone (as that of a lost character does), what is told apart
#: beyond it, and the distance from the best chain at which another has no weight.
LOW, HIGH, MOST, NEGLIGIBLE = -3, 14, 80, 8
#: Rounds of EM, values that the corpus prior counts for in each source, posterior that makes a value garbled.
ROUNDS, STRENGTH, GARBLED = 12, 20.0, 0.5

LOST = "�"
#: The name of the chain of text that was lost.
GONE = "lost"


def _byte_of(encoding: str) -> dict[str, int]:
    """Characters of the upper half; a byte that the encoding leaves undefined is the control character."""
    return {bytes([b]).decode(encoding, "ignore") or chr(b): b for b in range(0x80, 0x100)}


_BYTES = {e: _byte_of(e) for e in WRONG}
_CHARS = {e: {b: c for c, b in _byte_of(e).items()} for e in {w for _, w in ONE_BYTE}}


def _sequences(encoding: str) -> re.Pattern:
    """Well-formed UTF-8 sequences as they look in ``encoding``."""
    table_ = {b: c for c, b in _BYTES[encoding].items()}
    some = lambda lo, hi: "[" + re.escape("".join(table_[b] for b in range(lo, hi + 1))) + "]"
    tail = some(0x80, 0xBF)
    return re.compile(f"(?:{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{tail}|{some(0xF0, 0xF4)}{tail}{tail}{tail})+")


_UTF8 = {e: _sequences(e) for e in WRONG}
#: What a value with a wrong encoding, and hardly any other, shows. Such values aren't counted as text.
_SYMBOL = "[\u0080-\u00a9\u00ab-\u00b1\u00b3-\u00b6\u00b8\u00b9\u00bb-\u00bf\u00d7\u00f7\u02c6\u02dc\u2020\u2021\u2030\u203a\u20ac\u207f\u2200-\u25ff]"
_LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
_OTHER = "[\u0370-\u05ff\u0600-\u06ff]"
_TRACE = re.compile(
    "[\u00c2\u00c3\u00e2][\u0080-\u00bf]|" + "|".join(_UTF8[e].pattern for e in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850")) + "|"
    f"{_LATIN}{_SYMBOL}|{_SYMBOL}{_LATIN}{_SYMBOL}|{_LATIN}{_OTHER}|{_OTHER}{_LATIN}|[\u0080-\u00ff\u02c6\u02dc]{{3,}}|[\u0080-\u009f]|"
    + "|".join(f"(?:{p.pattern[:-1]}){{2,}}" for p in _UTF8.values())
)
#: Characters that stand between letters without being read; alone they are no sign of an encoding.
_UNREAD = frozenset("\u200c\u200d\u200e\u200f\u00a0\u00ad")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
_WORD = re.compile(r"[^\s\x00-\x2c\x2e-\x40\x5b-\x60\x7b-\x7f]*[^\x00-\x7f][^\s\x00-\x2c\x2e-\x40\x5b-\x60\x7b-\x7f]*")


def undo_utf8(text: str, encoding: str) -> str:
    """``text`` with every UTF-8 sequence that was read as ``encoding`` decoded; the rest stays."""
    of = _BYTES[encoding]

    def decode(m: re.Match) -> str:
        return bytes(of[c] for c in m.group()).decode("utf-8", "surrogateescape")

    undone = _UTF8[encoding].sub(decode, text)
    return text if re.search("[\ud800-\udfff]", undone) else undone


def undo_one_byte(text: str, read: str, written: str) -> str:
    """``text`` with every word that fits re-read: its bytes in ``read`` decoded as ``written``."""
    of, to = _BYTES[read], _CHARS[written]

    def decode(m: re.Match) -> str:
        word = m.group()
        if _UNREAD.issuperset(c for c in word if c > "\x7f"):
            return word
        out = []
        for c in word:
            if c < "\x80":
                out.append(c)
                continue
            b = of.get(c)
            if b is None:
                return word
            out.append(to[b])
        return "".join(out)

    return _WORD.sub(decode, text)


def _steps(text: str, one_byte: bool) -> Iterator[tuple[str, str]]:
    """Every single step back that changes ``text``: its name and the text before it."""
    for encoding in WRONG:
        undone = undo_utf8(text, encoding)
        if undone != text:
            yield encoding, undone
    for read, written in ONE_BYTE if one_byte else ():
        undone = undo_one_byte(text, read, written)
        if undone != text:
            yield f"{written}>{read}", undone


def undo(text: str, chain: str) -> str:
    """``text`` before ``chain``, whose last step comes first."""
    for step in chain.split("+"):
        written, _, read = step.partition(">")
        text = undo_one_byte(text, read, written) if read else undo_utf8(text, step)
    return text


def rebuilt(text: str) -> dict[str, str]:
    """The text before every chain that could have made ``text``: misread UTF-8 any number of times, by the same
    encoding or others, with at most one misread one-byte encoding among these steps.

    Each step back from misread UTF-8 makes the text shorter, so there is an end.
    """
    found: dict[str, str] = {}
    todo, depth, known = [("", text)], 0, set()
    while todo:
        depth, before = depth + 1, todo
        todo = []
        for name, after in before:
            for step, undone in _steps(after, ">" not in name):
                chain = f"{name}+{step}" if name else step
                state = undone, ">" in chain
                if depth <= APART or state not in known:
                    found[chain] = undone
                    known.add(state)
                    if not undone.isascii():
                        todo.append((chain, undone))
    return found


def _plainness(chain: str) -> tuple[int, int, str]:
    """Order in which equal chains are tried: few steps, then few kinds of them."""
    return chain.count("+"), len(set(chain.split("+"))), chain


def _symbols(text: str) -> np.ndarray:
    """Characters as the model sees them: letters and signs of ASCII by class, others by themselves, rare scripts by block."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    out = np.where(c < 0x700, c, np.where((c >= 0x2000) & (c < 0x2600), c - 0x2000 + 0x700, 0xD00 + (c >> 8) % 0x200))
    lower, upper, digit = (c >= 97) & (c <= 122), (c >= 65) & (c <= 90), (c >= 48) & (c <= 57)
    out[lower], out[upper], out[digit] = 97, 65, 48
    return np.where((c < 128) & ~lower & ~upper & ~digit & (c > 32), 46, np.where(c <= 32, 32, out))


def _buckets(symbols: np.ndarray) -> np.ndarray:
    return (symbols[:-1] * 0x2545F + symbols[1:] * 0x9E3B) % PAIRS


class PairModel:
    """Log-probability of text by its character pairs, from counts of pairs (hashed) and of first characters."""

    def __init__(self, pairs: np.ndarray, firsts: np.ndarray) -> None:
        self.pairs, self.firsts = pairs, firsts
        self.alone = (firsts + SMOOTH) / (firsts.sum() + SMOOTH * ALPHABET)

    def score(self, text: str) -> float:
        s = _symbols(text)
        return float(np.log((self.pairs[_buckets(s)] + BACKOFF * self.alone[s[1:]]) / (self.firsts[s[:-1]] + BACKOFF)).sum())


def count_pairs(texts: DataFrame) -> PairModel:
    """The pair model of all values in column ``text`` that show no trace of a wrong encoding.

    Counted in parts and summed; at most ``PAIRS + ALPHABET`` numbers reach the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, firsts = np.zeros(PAIRS, np.int64), np.zeros(ALPHABET, np.int64)
        for batch in batches:
            kept = [t for t in batch["text"] if t and (t.isascii() or LOST not in t and not _TRACE.search(t))]
            if kept:
                s = _symbols("\n".join(kept))
                pairs += np.bincount(_buckets(s), minlength=PAIRS)
                firsts += np.bincount(s[:-1], minlength=ALPHABET)
        for kind, counts in ((0, pairs), (1, firsts)):
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"kind": kind, "at": at, "n": counts[at]})

    total = texts.select("text").mapInPandas(count, "kind int, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()
    arrays = []
    for kind, size in ((0, PAIRS), (1, ALPHABET)):
        counts, part = np.zeros(size, np.float32), total[total["kind"] == kind]
        counts[part["at"].to_numpy(np.int64)] = part["n"].to_numpy()
        arrays.append(counts)
    return PairModel(*arrays)


#: Words by shape that a worker remembers; only speed depends on it.
REMEMBERED = 200_000
_SHAPES = str.maketrans(
    {c: "a" if 97 <= c <= 122 else "A" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else " " if c <= 32 else "." for c in range(128)}
)
_RUNS = re.compile(r"(a|A|0|\.)\1{2,}")


class Evidence:
    """What speaks for each chain of a value.

    Chains change only the words with characters beyond ASCII, and the model sees ASCII characters by
    class; so the gain of a chain is a sum over such words, and words of one shape gain alike.
    """

    def __init__(self, model: PairModel) -> None:
        self.model, self._shapes = model, {}

    def _gains(self, word: str) -> dict[str, float]:
        shape = _RUNS.sub(r"\1\1", word.translate(_SHAPES))
        found = self._shapes.get(shape)
        if found is None:
            # Letters of another script may also be look-alikes; that explains a word as well as it can.
            plain = unify(shape)
            base = self.model.score(shape) if plain == shape else max(self.model.score(shape), self.model.score(plain))
            found = {name: self.model.score(undone) - base for name, undone in rebuilt(shape).items()}
            if len(self._shapes) >= REMEMBERED:
                self._shapes.clear()
            self._shapes[shape] = found
        return found

    def __call__(self, text: str | None) -> tuple[str, list[str], list[str]] | None:
        """A signature of whole nats, the chains and the rebuilt texts, best first.

        None for a value that no chain could have made. A value with replacement characters has lost text.
        """
        if not text or text.isascii():
            return None
        gains: dict[str, float] = {}
        for word in re.split(r"[\x00-\x20]+", text):
            if not word.isascii():
                for name, gain in self._gains(word).items():
                    gains[name] = gains.get(name, 0.0) + gain
        least = max([LOW, *(g - NEGLIGIBLE for g in gains.values())])
        texts: dict[str, str] = {}
        for name in sorted((c for c, g in gains.items() if g > least), key=lambda c: (-gains[c], _plainness(c))):
            undone = undo(text, name)
            if undone != text and undone not in texts.values():
                texts[name] = undone
        # A replacement character is what a decoder writes for bytes that it can't read.
        lost = [f"{GONE}:{HIGH}"] if LOST in text else []
        if not texts and not lost:
            return None
        best = max((gains[c] for c in texts), default=0.0)
        signature = lost + [f"{c}:{_nats(best) - round(best - gains[c])}" for c in texts]
        return " ".join(signature), list(texts), list(texts.values())


def _nats(gain: float) -> int:
    """A gain in whole nats, coarser beyond what decides alone, so that there are few signatures."""
    return int(np.floor(gain)) if gain < HIGH else HIGH + 2 * int(min(gain - HIGH, MOST) // 2)


def _parse(signature: str) -> list[tuple[str, float]]:
    """The chains of a signature with their evidence; text that was lost is a chain as well."""
    return [(name, float(nats)) for name, _, nats in (part.rpartition(":") for part in signature.split(" "))]


def expectation_maximisation(counts: dict[str, float], clean: float, prior: dict[str, float] | None = None, strength: float = 1.0) -> dict[str, float]:
    """Share of each chain (and of ``""``, none) among values with these signatures and ``clean`` others.

    ``prior`` counts as ``strength`` values of its shares.
    """
    parsed = [(n, [("", 0.0), *_parse(s)]) for s, n in counts.items()]
    names = sorted({c for _, chains in parsed for c, _ in chains} | {""})
    start = prior or {c: (0.9 if not c else 0.1 / max(1, len(names) - 1)) for c in names}
    floor = min(start.values())
    base = {c: start.get(c, floor) for c in names}
    share = dict(base)
    total = clean + sum(counts.values()) + strength
    for _ in range(ROUNDS):
        expected = {c: strength * base[c] for c in names}
        expected[""] += clean
        for n, chains in parsed:
            weights = [share[c] * np.exp(g) for c, g in chains]
            whole = sum(weights)
            for (c, _), w in zip(chains, weights):
                expected[c] += n * w / whole
        share = {c: max(v / total, 1e-9) for c, v in expected.items()}
    return share


def posterior(signature: str, share: dict[str, float]) -> tuple[float, int]:
    """Probability that the value is garbled, and which of the chains that can be undone is likeliest (-1: there is none)."""
    floor = min(share.values())
    weights = {c: share.get(c, floor) * float(np.exp(g)) for c, g in _parse(signature)}
    whole = sum(weights.values())
    undone = [w for c, w in weights.items() if c != GONE]
    return whole / (whole + share.get("", 0.0)), int(np.argmax(undone)) if undone else -1


def find_garbled(values: DataFrame) -> DataFrame:
    """The garbled values among ``(table_name, row_id, source, field_name, text)``, with ``chain`` and ``restored``.

    Every value is read whole; null, empty and ASCII ones are never garbled. ``restored`` is null where
    characters were lost. Repeated rows come out once. Hot sources are summed up by signature before they
    are shuffled, and the number of signatures is bounded, so no task holds the rows of a source.
    """
    spark = values.sparkSession
    model = spark.sparkContext.broadcast(count_pairs(values))

    @F.pandas_udf("signature string, chains array<string>, texts array<string>")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        evidence = Evidence(model.value)
        for texts in batches:
            rows = [evidence(t) or (None, None, None) for t in texts]
            yield pd.DataFrame(rows, columns=["signature", "chains", "texts"], index=texts.index)

    # Marked so that the filter on the signature doesn't run the function a second time.
    suspects = values.filter(F.col("text").rlike(r"[^\x00-\x7f]")).withColumn("e", weigh.asNondeterministic()("text")).filter("e.signature IS NOT NULL")
    columns = ["table_name", "row_id", "source", "field_name", "text", "e.signature", "e.chains", "e.texts"]
    suspects = cut_lineage(suspects.select(*columns).withColumn("source", F.coalesce("source", F.lit(""))))

    group = ["source", "field_name"]
    by_signature = suspects.groupBy(*group, "signature").agg(F.count("*").alias("n"))
    sizes = values.groupBy(F.coalesce("source", F.lit("")).alias("source"), "field_name").agg(F.count("text").alias("size"))
    corpus = {r["signature"]: float(r["n"]) for r in by_signature.groupBy("signature").agg(F.sum("n").alias("n")).collect()}
    size = values.agg(F.count("text").alias("n")).first()["n"]
    shares = spark.sparkContext.broadcast(expectation_maximisation(corpus, size - sum(corpus.values())))

    @F.pandas_udf("array<struct<signature string, garbled double, best int>>")
    def judge(seen: pd.Series, sizes_: pd.Series) -> pd.Series:
        out = []
        for held, whole in zip(seen, sizes_):
            counts = {h["signature"]: float(h["n"]) for h in held}
            share = expectation_maximisation(counts, max(0.0, float(whole) - sum(counts.values())), shares.value, STRENGTH)
            out.append([{"signature": s, "garbled": p, "best": b} for s in counts for p, b in [posterior(s, share)]])
        return pd.Series(out)

    grouped = by_signature.groupBy(*group).agg(F.collect_list(F.struct("signature", "n")).alias("seen")).join(sizes, group)
    judged = grouped.select(*group, F.explode(judge("seen", "size")).alias("j")).select(*group, "j.*").filter(F.col("garbled") > GARBLED)
    found = suspects.join(judged, [*group, "signature"])
    lost = F.col("signature").startswith(f"{GONE}:")
    return found.select(
        "table_name",
        "row_id",
        "field_name",
        "text",
        F.when(lost, GONE).otherwise(F.get("chains", "best")).alias("chain"),
        F.when(~lost & (F.col("best") >= 0), F.get("texts", "best")).alias("restored"),
        "garbled",
    ).dropDuplicates(["table_name", "row_id", "field_name", "text"])


def values_of(df: DataFrame, name: str, row_id: str, source: object, fields: list[str]) -> DataFrame:
    """The fields of a table as rows ``(table_name, row_id, source, field_name, text)``, without nulls."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in fields)))
    rows = df.select(F.lit(name).alias("table_name"), F.col(row_id).alias("row_id"), source.alias("source"), each.alias("v"))
    return rows.select("table_name", "row_id", "source", "v.*").filter(F.col("text").isNotNull())


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "website_metadata").select("metadata_id", "title", "description", "canonical_url", "og_url", "favicon_url"))
    leads = spread(table(spark, sf_dir, "page_leads").select("lead_id", "business_name", "website"))
    of_pages = values_of(pages, "website_metadata", "metadata_id", host_of(F.coalesce("canonical_url", "og_url", "favicon_url")), ["title", "description"])
    return of_pages.unionByName(values_of(leads, "page_leads", "lead_id", host_of(F.col("website")), ["business_name"]))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled titles, descriptions and business names."""
    return find_garbled(_values(spark, sf_dir)).select("table_name", "row_id", "field_name").distinct()


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled values with the text as it was written, where nothing was lost."""
    return find_garbled(_values(spark, sf_dir)).select("table_name", "row_id", "field_name", "text", "chain", "restored")


QUERIES = {"p2_found": p2_found, "p2_restored": p2_restored}
SQL: dict[str, str] = {}
