"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Everything is column expressions. A pattern's matches and the pieces between them (split by the same pattern)
give each match its place by a running sum of lengths, so whole texts are scanned and nothing leaves the JVM.

The models are first-order: counts of neighbouring characters over labelled samples, smoothed, as one table of
log-likelihood ratios with a cell for each pair of characters (67 x 67, whatever the data). A candidate is a run
of identifier characters; it is added when its ratio, in total and per character, favours a random string.

Defined results: a null text is the empty text; an empty text has no spans; repeated rows give repeated results;
an empty table gives no row, and without samples of both labels no span is added. Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.functions.core import let
from flowsift.llm.common import text_or_empty

# Fixed patterns of the base scan.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that are long enough
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
WORDS_OF_ASSIGN = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")

#: Runs the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CELLS = len(ALPHABET)
#: Weight of a character's own frequency among the pairs that begin like it.
BACK_OFF = 5.0
SPANS = "array<struct<start:bigint,stop:bigint,kind:string,hit:string>>"
#: Matches folded at once.
GROUP = 1024


@dataclass(frozen=True)
class Settings:
    """sample_documents bounds the labelled rows that train the ordinary model; smooth is added to each character's count."""

    sample_documents: int = 4000
    smooth: float = 0.5
    least_total: float = 8.0
    least_per_pair: float = 0.4


def _no_spans() -> Column:
    return F.array().cast(SPANS)


def _chosen(items: Column, state: Column, step) -> Column:
    """The values that step picks along items: step(state, item) gives (next state, pick?, value).

    A fold copies its result at each step, so it runs over groups of GROUP items and the groups' picks are put
    together once: the work grows with the items, not with their square.
    """
    def whole(bound):
        def in_group(acc, item):
            after, pick, value = step(acc["state"], item)
            found = F.when(pick, F.concat(acc["found"], F.array(value))).otherwise(acc["found"])
            return F.struct(after.alias("state"), found.alias("found"))

        def group(done, g):
            start = F.struct(F.element_at(done, -1)["state"].alias("state"), _no_spans().alias("found"))
            return F.concat(done, F.array(F.aggregate(F.slice(bound, g * GROUP + 1, F.lit(GROUP)), start, in_group)))

        begin = F.array(F.struct(state.alias("state"), _no_spans().alias("found")))
        groups = F.sequence(F.lit(0), F.floor(F.size(bound) / GROUP).cast("int"))
        return F.aggregate(groups, begin, group, lambda done: F.flatten(F.transform(done, lambda g: g["found"])))

    return let(items, whole)


def _spans(text: Column, pattern: str, kind: str, guard: Column, passing) -> Column:
    """array<struct<start, stop, kind, hit>> of the pattern's matches in code points; guard: the pattern may match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(pieces, hits, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))

    def step(at, pair):
        begin = at + F.length(pair["piece"])
        end = begin + F.coalesce(F.length(pair["hit"]), F.lit(0))
        return end, pair["hit"].isNotNull() & passing(pair["hit"]), _span(begin, end, F.lit(kind), pair["hit"])

    return F.when(guard, _chosen(pairs, F.lit(0).cast("bigint"), step)).otherwise(_no_spans())


def _span(start: Column, stop: Column, kind: Column, hit: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"), kind.alias("kind"), hit.alias("hit"))


def _uncovered(base: Column, judged: Column) -> Column:
    """The judged spans that no base span holds whole: along the starts, with the furthest end of base spans so far."""
    keyed = lambda spans, after: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(after).alias("after"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["hit"].alias("hit")))

    def step(reach, s):
        return (F.when(s["after"], reach).otherwise(F.greatest(reach, s["stop"])), s["after"] & (s["stop"] > reach),
                _span(s["start"], s["stop"], s["kind"], s["hit"]))

    return _chosen(F.array_sort(F.concat(keyed(base, False), keyed(judged, True))), F.lit(-1).cast("bigint"), step)


def with_base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and base: array of the spans of the fixed patterns."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    text = F.col("text")
    folded = F.lower(text)
    named = F.lit(False)
    for word in WORDS_OF_ASSIGN:
        named = named | F.contains(folded, F.lit(word))
    always = lambda hit: F.lit(True)
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_VALUE
    return rows.withColumn("base", F.concat(
        _spans(text, ASSIGN, "assign", named, value),
        _spans(text, ACCESS, "access", F.contains(text, F.lit("AKIA")), lambda hit: F.length(hit) >= ACCESS_LENGTH),
        _spans(text, HEX, "hex", F.rlike(text, F.lit(r"[0-9a-f]{24}")), always)))


def corpus_samples(scanned: DataFrame, rows: int, settings: Settings) -> DataFrame:
    """(sample, random): labelled strings of the corpus.

    Random: what the fixed patterns hold in all rows, and one hash string a sampled document in each of two
    alphabets. Ordinary: the words of letters, digits and underscores of about ``sample_documents`` documents,
    drawn by the hash of the doc_id, long enough to be identifiers and not part of a random string.
    """
    value = lambda s: F.when(s["kind"] == "assign", F.regexp_extract(s["hit"], ASSIGN, 2)).otherwise(s["hit"])
    found = scanned.filter(F.size("base") > 0).select(F.explode(F.transform("base", value)).alias("sample"), F.lit(True).alias("random"))
    share = max(1, -(-rows // settings.sample_documents))
    picked = scanned.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    drawn = picked.filter(F.col("doc_id").isNotNull()).select(
        F.explode(F.array(digest, F.base64(F.unhex(digest)))).alias("sample"), F.lit(True).alias("random"))
    words = F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_-]{5,}"), F.lit(0))
    plain = picked.filter(F.size("base") == 0).select(F.explode(words).alias("sample"), F.lit(False).alias("random"))
    return found.union(drawn).union(plain)


def train(samples: DataFrame, smooth: float) -> list[float] | None:
    """The ratio table by (first, second) character, row after row; None where a label has no sample.

    ``samples`` has columns sample (string) and random (boolean). Pairs are counted with map-side combine; at
    most 2 x 67 x 67 counts reach the driver.
    """
    chars = F.split("sample", "")
    pairs = samples.filter(F.length("sample") >= 2).select("random", F.explode(F.zip_with(
        chars, F.slice(chars, F.lit(2), F.length("sample")), lambda a, b: F.concat(a, b))).alias("pair"))
    counted = pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).filter(
        F.rlike("pair", F.lit(r"\A[A-Za-z0-9+/_=-]{2}\z"))).collect()
    place = {c: i for i, c in enumerate(ALPHABET)}
    logs: dict[bool, list[float]] = {}
    for label in (True, False):
        pairs_seen = [[0] * CELLS for _ in range(CELLS)]
        for row in counted:
            if row["random"] == label:
                pairs_seen[place[row["pair"][0]]][place[row["pair"][1]]] += row["n"]
        second = [smooth + sum(seen[b] for seen in pairs_seen) for b in range(CELLS)]
        alone = [n / sum(second) for n in second]
        # Pairs fall back on how common the second character is.
        logs[label] = [
            math.log((seen[b] + BACK_OFF * alone[b]) / (sum(seen) + BACK_OFF)) for seen in pairs_seen for b in range(CELLS)]
    if len({row["random"] for row in counted}) < 2:
        return None
    return [r - p for r, p in zip(logs[True], logs[False])]


def ratio_of(token: Column, table: list[float]) -> Column:
    """Sum of the table's cells over the neighbouring characters of a string over the alphabet."""
    cells = F.split(F.lit(",".join(f"{v:.6f}" for v in table)), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc, c):
        here = F.instr(F.lit(ALPHABET), c) - 1
        add = F.when((acc["last"] >= 0) & (here >= 0), F.get(cells, acc["last"] * CELLS + here)).otherwise(0.0)
        return F.struct(here.alias("last"), (acc["sum"] + add).alias("sum"))

    return F.aggregate(F.split(token, ""), start, step, lambda acc: acc["sum"])


def add_markov_spans(scanned: DataFrame, table: list[float] | None, settings: Settings) -> DataFrame:
    """scanned with added: spans of candidates the models hold for random and no base span covers."""
    if table is None:
        return scanned.withColumn("added", _no_spans())

    def random(hit):
        score = ratio_of(hit, table)
        return score >= F.greatest(F.lit(settings.least_total), settings.least_per_pair * (F.length(hit) - 1))

    text = F.col("text")
    judged = scanned.withColumn("judged", _spans(text, CANDIDATE, "markov", F.rlike(text, F.lit(CANDIDATE)), random))
    return judged.withColumn(
        "added", F.when(F.size("judged") > 0, _uncovered(F.col("base"), F.col("judged"))).otherwise(_no_spans())).drop("judged")


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, settings: Settings = Settings(), samples: DataFrame | None = None) -> DataFrame:
    """doc_id, the counts by kind, base_sha256 and spans of every row; models from samples, or from the corpus."""
    scanned = with_base_spans(docs)
    if samples is None:
        samples = corpus_samples(scanned, docs.count(), settings)
    table = train(samples, settings.smooth)
    whole = add_markov_spans(scanned, table, settings)
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    found = whole.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        joined(F.col("base")).alias("base"), joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("bigint").alias("n_markov"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_markov")
