"""Personal identifiers by bootstrapped contextual extraction: seeds induce patterns, patterns discover identifiers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, materialize, own_names, release

#: What may be an identifier: a phone number, card or IBAN in several words, or a word with a digit or an @, without punctuation at its ends.
MENTION = re.compile(
    r"\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.])\+?\d{1,3}[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])"
    r"|(?<![\w.])\+\d{1,3}(?:[ .-]\(?\d{2,5}\)?){2,4}(?![\w-])"
    r"|(?<![\d-])(?:\d{4}[ -]){3}\d{4}(?![\d-])"
    r"|(?<!\w)[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){3,7}(?: (?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?|(?: [A-Z0-9]{4}){2} (?=[A-Z]{0,2}\d)[A-Z0-9]{3})(?!\w)"
    r"|[^\W_](?:[^\s\"'<>|,;()\[\]{}]*[^\W_])?"
)
_SIGN = re.compile(r"[\d@]")
_EDGE = frozenset(" \t\r\n\f\v\"'<>|,;()[]{}\u00a0\u2028\u2029")
_PHONE = re.compile(r"^(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:\d{1,3}[ .-])?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4})$")
_EMAIL = re.compile(r"^[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}$")
_IPV4 = re.compile(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
_SSN = re.compile(r"^(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}$")
_IBAN = re.compile(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$")
_SECRET = re.compile(r"^(?=[^\s]*\d)[0-9A-Fa-f]{32,}$|^(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9_\-+/=]{32,}$|^AKIA[0-9A-Z]{16}$|^(?:sk|pk|ghp|xox[bp])[-_][A-Za-z0-9_-]{16,}$")


def seed_kind(text: str) -> str | None:
    """The kind of an identifier that its form alone gives away, or null."""
    digits = re.sub(r"[ -]", "", text)
    if "@" in text:
        return "email" if _EMAIL.match(text) else None
    if _IPV4.match(text):
        return "ip"
    if digits.isdigit() and digits.isascii() and 13 <= len(digits) <= 19:
        return "card"
    if _PHONE.match(text):
        return "phone"
    if _SSN.match(text):
        return "ssn"
    if _IBAN.match(text.replace(" ", "")):
        return "iban"
    return "secret" if _SECRET.match(text) else None


_RUNS = re.compile(r"([A-Z]+)|([^\W\d_]+)|(\d+)|(\s+)")


def shape(text: str) -> str:
    """The form of a word: A for capitals, a for other letters, 9 for digits with their count from 3 on; the rest as it is."""

    def one(m: re.Match) -> str:
        n = m.end() - m.start()
        if m[3]:
            return "9" * n if n < 3 else f"9{{{n}}}"
        return "A" if m[1] else "a" if m[2] else " "

    return _RUNS.sub(one, text)


def mentions(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, mention, the two words before, the word after), in lower case the words, of any length; on its line only."""
    at = 0
    while sign := _SIGN.search(text, at):
        p = first = sign.start()
        while first > at and text[first - 1] not in _EDGE:
            first -= 1
        begin, stop = text.rfind("\n", 0, p) + 1, text.find("\n", p)
        stop = len(text) if stop < 0 else stop
        found = MENTION.match(text, first - 1, stop) if first > at and text[first - 1] == "(" else None
        found = found or MENTION.search(text, first, stop)
        if not found or found.start() > p or found.end() <= p:
            at = p + 1
            continue
        start, at = found.span()
        yield start, at, found.group(), " ".join(reversed(_words(text, start, begin, -1, 2))), " ".join(_words(text, at, stop, 1, 1))


def _words(text: str, at: int, end: int, step: int, most: int) -> list[str]:
    """Up to `most` words of any length next to `at`, towards `end`, nearest first, in lower case. Words end at white space, quotes,
    commas, brackets and the like, so that each word of a line is read for its neighbouring mentions only."""
    out = []
    while len(out) < most:
        edge = (_right if step > 0 else _left)(text, at, end)
        if edge is None:
            break
        out.append(text[edge[0] : edge[1]].lower())
        at = edge[1] if step > 0 else edge[0]
    return out


_NEXT = re.compile(r"[^\s\"'<>|,;()\[\]{}]+")


def _right(text: str, at: int, end: int) -> tuple[int, int] | None:
    found = _NEXT.search(text, at, end)
    return found.span() if found else None


def _left(text: str, at: int, begin: int) -> tuple[int, int] | None:
    while at > begin and (text[at - 1] in _EDGE or text[at - 1].isspace()):
        at -= 1
    first = at
    while first > begin and not (text[first - 1] in _EDGE or text[first - 1].isspace()):
        first -= 1
    return (first, at) if first < at else None


def coarse(text: str) -> str:
    """The class of a mention whatever its form: @ with an at sign, 9 of digits and signs only, a9 of letters and digits."""
    return "@" if "@" in text else "a9" if any(map(str.isalpha, text)) else "9"


def patterns_of(mention: str, before: str, after: str) -> list[str]:
    """The lexical patterns that a mention instantiates: its form within its left context, and within its right context; its
    contexts by themselves, whatever the form: the two words before (C2), and the words before and after (CB); and with its
    coarse class only, the one word before (K1) and the one after (KR)."""
    s, k = shape(mention), coarse(mention)
    last = before.split(" ")[-1] if before else ""
    out = [f"L2|{before}|{s}"] if before else []
    if last:
        out += [f"L1|{last}|{s}", f"K1|{last}|{k}"]
    if last != before:
        out.append(f"C2|{before}")
    if after:
        out += [f"R1|{s}|{after}", f"KR|{k}|{after}"]
    if last and after:
        out.append(f"CB|{last}|{after}")
    return [*out, f"S|{s}"]


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for text in batch["text"].to_pylist():
            if text:
                for _, _, m, before, after in mentions(text):
                    kind = seed_kind(m)
                    rows += [(p, m, kind) for p in patterns_of(m, before, after)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["pattern", "instance", "kind"])
    release()


def bootstrap(docs: DataFrame, rounds: int = 3, support: int = 3, trust: float = 0.8) -> DataFrame:
    """(pattern, kind, score) of the patterns to be trusted.

    The graph has an edge for each pattern and distinct instance that occur together in any document, seeds being the
    instances whose form gives their kind away. A round scores each pattern for each kind by the summed scores of its
    instances over their number plus one, and each instance that is not a seed by the noisy-or of its patterns that
    have `support` instances and score `trust` or more. Seeds score 1 for their kind. Patterns that score `trust` with
    `support` instances after the last round are returned, for their best kind (the first in alphabetical order on a tie).
    """
    bounded(docs.sparkSession)
    edges = docs.select("text").where("text is not null").mapInArrow(_mentions, "pattern string, instance string, kind string")
    edges = materialize(edges.groupBy("pattern", "instance", "kind").agg(F.count(F.lit(1)).alias("n")), "pii-graph")
    sizes = materialize(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= support), "pii-patterns")
    seeds = edges.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    scored = seeds
    trusted = None
    for r in range(rounds):
        mass = edges.select("pattern", "instance").join(scored, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
        trusted = mass.join(sizes, "pattern").withColumn("score", F.col("mass") / (F.col("size") + 1.0)).where(F.col("score") >= trust)
        trusted = materialize(trusted.select("pattern", "kind", "score"), f"pii-round-{r}")
        if r + 1 < rounds:
            new = edges.where("kind is null").select("pattern", "instance").join(trusted, "pattern")
            new = new.groupBy("instance", "kind").agg((1.0 - F.exp(F.sum(F.log(F.greatest(1.0 - F.col("score"), F.lit(1e-12)))))).alias("score"))
            scored = seeds.unionByName(new)
    best = trusted.groupBy("pattern").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("b"))
    return best.select("pattern", "b.kind", (-F.col("b.s")).alias("score"))


FIND = "array<struct<start:int,length:int,kind:string,identifier:string,score:double>>"


def finder(model: dict[str, tuple[str, float]]) -> Callable[[str], list[tuple]]:
    """Identifiers of a text: seeds by form (score 1), and mentions that a trusted pattern claims (the best score's kind)."""

    def find(text: str) -> list[tuple]:
        out = []
        for start, end, m, before, after in mentions(text):
            kind, score = seed_kind(m), 1.0
            if not kind:
                claims = [model[p] for p in patterns_of(m, before, after) if p in model]
                if not claims:
                    continue
                kind, score = max(claims, key=lambda c: (c[1], c[0]))
            out.append((start, end - start, kind, m, score))
        return out

    return find


MODEL_ROWS = 500_000
"""Trusted patterns that may travel with the tasks (some 40 MB); more are joined by pattern."""


def extract(docs: DataFrame, model: DataFrame) -> DataFrame:
    """docs with _pl_found, the identifiers of its text as FIND, in order; null for a null text."""
    spark = docs.sparkSession
    bounded(spark)
    rows = model.limit(MODEL_ROWS + 1).collect()
    if len(rows) <= MODEL_ROWS:
        shipped = spark.sparkContext.broadcast({r["pattern"]: (r["kind"], r["score"]) for r in rows})

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            find = finder(shipped.value)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string()), ("identifier", pa.string()), ("score", pa.float64())]))
            names = ("start", "length", "kind", "identifier", "score")
            for texts in batches:
                yield pa.array([None if t is None else [dict(zip(names, f, strict=True)) for f in find(t)] for t in texts.to_pylist()], kind)
            release()

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return docs.withColumn("_pl_found", F.arrow_udf(run, FIND)(F.col("text")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, text in zip(b["_pl_key"].to_pylist(), b["text"].to_pylist(), strict=True):
                for start, end, m, before, after in mentions(text or ""):
                    out += [(key, start, end - start, m, seed_kind(m), p) for p in patterns_of(m, before, after)]
            types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], ["_pl_key", "start", "length", "identifier", "seed", "pattern"])

    keyed = docs.withColumn("_pl_key", F.sha2("text", 256))
    each = keyed.select("_pl_key", "text").dropDuplicates(["_pl_key"]).mapInArrow(spread, "_pl_key string, start int, length int, identifier string, seed string, pattern string")
    each = each.join(model, "pattern", "left").groupBy("_pl_key", "start", "length", "identifier", "seed").agg(F.max(F.when(F.col("score").isNotNull(), F.struct("score", "kind"))).alias("c"))
    each = each.where("seed is not null or c is not null").withColumn("kind", F.coalesce("seed", "c.kind")).withColumn("score", F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.col("c.score")))
    each = each.groupBy("_pl_key").agg(F.array_sort(F.collect_list(F.struct("start", "length", "kind", "identifier", "score"))).alias("_pl_found"))
    found = F.when(F.col("text").isNotNull(), F.coalesce("_pl_found", F.array().cast(FIND)))
    return keyed.join(each, "_pl_key", "left").withColumn("_pl_found", found).drop("_pl_key")


def identifiers(docs: DataFrame, rounds: int = 3, support: int = 3, trust: float = 0.8) -> DataFrame:
    """(doc_id, start, length, kind, identifier, score): every identifier found in every text; start counts characters from 0.

    Patterns are learnt from all texts (see bootstrap) and then applied to all texts. Kinds: email, phone, card, ip, ssn, iban, secret.
    Mentions have a digit or an @; what is of letters only is not looked at. Null and empty texts have none; a null doc_id is carried as null; repeated rows are reported each. Other columns
    are not read. Very long texts are read whole. An empty table gives no rows.

    Scale: the corpus is read twice and not shuffled; the graph has the mentions only. The trusted patterns travel with the tasks up
    to a checked number, and are joined by pattern beyond it.
    """
    d = extract(docs.select("doc_id", "text"), bootstrap(docs, rounds, support, trust))
    return d.select("doc_id", F.explode("_pl_found").alias("f")).select("doc_id", "f.*")


def redact(docs: DataFrame, rounds: int = 3, support: int = 3, trust: float = 0.8) -> DataFrame:
    """docs with each identifier in text replaced by its kind in angle brackets, and n_chars, if there is one, set to the
    new length where the text changed. No row goes; null and empty texts stay as they are."""
    docs, names = own_names(docs)
    d = extract(docs, bootstrap(docs, rounds, support, trust))
    size = F.size("_pl_found")

    def cut(i):
        f = F.element_at("_pl_found", i + 1)
        begin = F.when(i == 0, F.lit(0)).otherwise(F.element_at("_pl_found", F.greatest(i, F.lit(1))).start + F.element_at("_pl_found", F.greatest(i, F.lit(1))).length)
        return F.concat(F.substring("text", begin + 1, f.start - begin), F.lit("<"), F.upper(f.kind), F.lit(">"))

    body = F.array_join(F.transform(F.sequence(F.lit(0), size - 1), cut), "")
    text = F.when(size > 0, F.concat(body, F.expr("substring(text, _pl_found[size(_pl_found) - 1].start + _pl_found[size(_pl_found) - 1].length + 1)"))).otherwise(F.col("text"))
    d = d.withColumn("_pl_text", text)
    for c in docs.columns:
        if c.lower() == "n_chars":
            d = d.withColumn(c, F.when(size > 0, F.length("_pl_text").cast(d.schema[c].dataType)).otherwise(F.col(c)))
    return d.withColumn("text", F.col("_pl_text")).select(*docs.columns).withColumnsRenamed(names)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers(spark.read.parquet(f"{sf_dir}/documents.parquet"))
