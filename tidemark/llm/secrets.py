"""Secrets in text: fixed patterns, and strings that a Markov model takes for random rather than for identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the base patterns and the characters that a match (of assign: its value) needs at least
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {
    "assign": (ASSIGN, 12),
    "access": (r"AKIA[A-Z0-9]+", 18),
    "hex": (r"[0-9a-f]+", 16),
}

#: Strings that the models compare.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
IDENTIFIER = r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_-]{5,}"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=."
#: Documents that the models are fitted on (about as many, by hash of the id; fewer where there are fewer).
SAMPLE_DOCS = 4_000
#: Log-likelihood ratio, in nats, from which a string counts as random.
THRESHOLD = 12.0
#: Counts that each pair of characters starts with: the random model's start it as a uniform source.
PRIOR_RANDOM, PRIOR_ORDINARY = 2.0, 0.1
#: Matches that are walked at a time; characters of a stretch of text at least, and stretches of a text at most.
BLOCK, STRETCH, STRETCHES = 64, 4_096, 256


def _keyed(pattern: str, kind: str) -> str:
    """The same matches, found without a try at each character of a run that is too short."""
    if kind == "hex":
        return r"(?<![0-9a-f])[0-9a-f]{16,}"
    if kind == "access":
        return r"AKIA[A-Z0-9]{14,}"
    return pattern


def _positions(text: Column, pattern: str, value_group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, value>> of all matches, left to right: the pieces between matches give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    rows = F.arrays_zip(found.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("g"))
    walked = once(F.filter(rows, lambda r: r["m"].isNotNull()), _walk_blocks)
    kept = F.filter(walked, lambda s: F.char_length(s["value"]) >= least) if least else walked
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,end:int,value:string>>"


def once(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often and wherever it is used."""
    return F.transform(F.array(value), then)[0]


def _walk_blocks(rows: Column) -> Column:
    """Spans of all matches. A list that grows is copied each time, so none grows beyond a block: each is walked from its own start."""
    def of(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda acc, x: F.struct(
            (acc["at"] + x["n"]).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")), lambda acc: acc["all"])
        return F.flatten(F.zip_with(blocks, starts, lambda x, at: _walk(x["rs"], at)))

    cut = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(rows) - 1, F.lit(BLOCK)).cast("int")), lambda k: F.slice(rows, k * BLOCK + 1, F.lit(BLOCK)))
    return once(F.transform(cut, lambda rs: F.struct(rs.alias("rs"), F.aggregate(rs, F.lit(0), lambda n, r: n + _length(r)).alias("n"))), of)


def _length(r: Column) -> Column:
    return F.char_length(r["g"]) + F.char_length(r["m"])


def _walk(rows: Column, at: Column) -> Column:
    """The spans of a block's matches from the place where the block begins."""
    return F.aggregate(
        rows, F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")),
        lambda acc, r: F.struct(
            (acc["at"] + _length(r)).alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + F.char_length(r["g"])).alias("start"), (acc["at"] + _length(r)).alias("end"),
                                                r["v"].alias("value"))).alias("out")),
        lambda acc: acc["out"])


def base_spans(text: Column, kind: str) -> Column:
    pattern, least = BASE[kind]
    return _positions(text, _keyed(pattern, kind), 2 if kind == "assign" else 0, least)


def _pairs(strings: Column) -> Column:
    """array<int>: codes of neighbouring characters, prev * n + next; 0 stands for the start and for other characters."""
    n = len(SYMBOLS) + 1

    def of(string: Column) -> Column:
        # characters by one split: a place in a string is found from its start each time
        codes = F.transform(F.filter(F.split(string, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(SYMBOLS)))
        return once(codes, lambda cs: F.zip_with(F.slice(F.concat(F.array(F.lit(0)), cs), F.lit(1), F.size(cs)), cs, lambda before, c: before * n + c))

    return F.flatten(F.transform(strings, of))


def labelled_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(random boolean, string): values that base patterns point at, and the identifiers and words beside them."""
    count = docs.count()
    per_million = math.ceil(1e6 * min(1.0, sample_docs / max(count, 1)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < per_million).select(text.alias("t"))
    named = [F.transform(base_spans(F.col("t"), k), lambda s: s["value"]) for k in BASE]
    rest = F.col("t")
    for kind, (pattern, _) in BASE.items():
        rest = F.regexp_replace(rest, _keyed(pattern, kind), " ")
    samples = rows.select(F.concat(*named).alias("yes"), F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0)).alias("no"))
    return samples.select(F.explode(F.array(F.struct(F.lit(True).alias("random"), F.col("yes").alias("s")),
                                            F.struct(F.lit(False).alias("random"), F.col("no").alias("s")))).alias("x")).select(
        F.col("x.random").alias("random"), F.explode("x.s").alias("string"))


def fit(samples: DataFrame) -> list[int]:
    """Log-likelihood ratios of each pair of characters, in hundredths of a nat: at most (symbols + 1) squared counts per label."""
    n = len(SYMBOLS) + 1
    counts = samples.select("random", F.explode(_pairs(F.array("string"))).alias("pair")).groupBy("random", "pair").agg(
        F.count(F.lit(1)).alias("n"))
    table = {True: [PRIOR_RANDOM] * (n * n), False: [PRIOR_ORDINARY] * (n * n)}
    for r in counts.collect():
        table[r.random][r.pair] += r.n
    out = []
    for prev in range(n):
        yes, no = (table[k][prev * n:(prev + 1) * n] for k in (True, False))
        sy, sn = sum(yes), sum(no)
        out += [round(100 * (math.log(a / sy) - math.log(b / sn))) for a, b in zip(yes, no)]
    return out


def ratio(string: Column, model: list[int]) -> Column:
    """Log-likelihood ratio of random against ordinary, in nats."""
    ratios = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    return F.aggregate(_pairs(F.array(string)), F.lit(0), lambda acc, p: acc + F.element_at(ratios, p + 1)) / 100.0


def find_secrets(docs: DataFrame, model: list[int], id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id and ``found``, an array of (start, kind index, kind, end) in order.

    Kinds: assign, access and hex by their patterns, and ``markov``: strings of 16 and more characters whose
    log-likelihood ratio reaches the threshold and that touch no other span. Places count code points. Null texts
    count as empty; a text without a hit has an empty array; repeated rows are told apart by nothing and each has
    its row. The work is one scan, without a shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("doc_id"), text.alias("__t")).select(
        "doc_id", *[base_spans(F.col("__t"), k).alias(f"__{k}") for k in BASE],
        _positions(F.col("__t"), CANDIDATE).alias("__strings"), "__t")

    def as_found(spans, order: int, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    base = F.concat(*[as_found(F.col(f"__{k}"), i, k) for i, k in enumerate(BASE)])
    # base spans by the stretches of text that they reach into, so that a string meets those near it only
    width = F.greatest(F.lit(STRETCH), F.call_function("div", F.char_length("__t"), F.lit(STRETCHES)).cast("int"))

    def untouched(x: Column) -> Column:
        base, strings, w = x["base"], x["strings"], x["w"]

        def at(place: Column) -> Column:
            return F.call_function("div", place, w).cast("int")

        def among(near: Column) -> Column:
            return F.filter(strings, lambda s: ~F.exists(F.slice(near, at(s["start"]) + 1, at(s["end"] - 1) - at(s["start"]) + 1), lambda bs: F.exists(
                bs, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))

        stretches = F.transform(F.sequence(F.lit(0), at(x["length"])), lambda k: F.filter(base, lambda b: (at(b["start"]) <= k) & (k <= at(b["end"] - 1))))
        return F.when((F.size(base) > 0) & (F.size(strings) > 0), once(stretches, among)).otherwise(strings)

    alone = once(F.struct(F.col("__base").alias("base"), F.col("__strings").alias("strings"), width.alias("w"), F.char_length("__t").alias("length")), untouched)
    random = F.filter(alone, lambda s: ratio(s["value"], model) >= threshold)
    found = F.array_sort(F.concat("__base", as_found(random, len(BASE), "markov")))
    return named.withColumn("__base", base).select("doc_id", found.alias("found"))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span replaced; of spans that overlap the first counts."""
    walked = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.coalesce(walked, text)
