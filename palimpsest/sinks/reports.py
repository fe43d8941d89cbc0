"""Tables and texts for a reader's review: corrections, audit, fix lists and the state of a batch."""

from __future__ import annotations

import json
import os
import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
BEGIN, END = "# BEGIN automatic fixes", "# END automatic fixes"
_BLOCK = re.compile(re.escape(BEGIN) + ".*?" + re.escape(END) + r"\s*", re.S)
_ENTRY = re.compile(r'^\s*"((?:[^"\\]|\\.)+)"\s*=\s*"((?:[^"\\]|\\.)*)"\s*$', re.M)


def flat(value: Column) -> Column:
    """A cell on one line: tabs and line ends become spaces."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\t\r\n]+", " ")


def flat_table(df: DataFrame) -> DataFrame:
    return df.select(*[flat(C(c)).alias(c) for c in df.columns])


def write_tsv(df: DataFrame, folder: str) -> None:
    flat_table(df).write.mode("overwrite").csv(folder, sep="\t", header=True, quote="")


def corrections_as_diff(corrections: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, text): corrections (before, after, source, rule) as a text that reads like a diff."""
    one = F.concat(F.lit("@@ "), flat(C("source")), F.lit(" "), flat(C("rule")), F.lit(" @@\n- "), flat(C("before")), F.lit("\n+ "), flat(C("after")))
    return corrections.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, one.alias("s")))), lambda x: x.s), "\n").alias("text"))


def review_rows(uncertain: DataFrame, low: DataFrame, suspicious: DataFrame) -> DataFrame:
    """(kind, file, page, excerpt): what a reader should look at; excerpts are cut to 160 characters."""
    cols = ["kind", "file", "page", "excerpt"]
    all_ = [d.select(*[C(c).cast("string") if c in d.columns else F.lit("").alias(c) for c in cols]) for d in (uncertain, low, suspicious)]
    return all_[0].unionByName(all_[1]).unionByName(all_[2]).withColumn("excerpt", F.substring("excerpt", 1, 160))


def read_review(spark, path: str) -> DataFrame:
    """The rows of a written review whose kind says that they are uncertain."""
    return spark.read.csv(path, sep="\t", header=True, quote="").where(C("kind").startswith("uncertain "))


def batch_status(builds: DataFrame) -> str:
    """JSON of (book, status, error): how many built, how many failed, and which."""
    n = builds.agg(F.count(F.lit(1)).alias("total"), F.count_if(C("status") == "ok").alias("ok"), F.count_if(C("status") != "ok").alias("failed")).first().asDict()
    books = [r.asDict() for r in builds.orderBy("book").collect()]  # one row a book that this driver built
    return json.dumps(n | {"books": books}, ensure_ascii=False, indent=1)


# Fix lists


def toml_string(s: str) -> str:
    named = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return '"' + "".join(named.get(c) or (f"\\u{ord(c):04x}" if ord(c) < 32 else c) for c in s) + '"'


def _raw(s: str) -> str:
    return toml_string(s)[1:-1]


def human_phrases(body: str) -> set[str]:
    """The texts that rules outside the automatic block are for."""
    return {json.loads(f'"{m[1]}"') for m in _ENTRY.finditer(_BLOCK.sub("", body))}


def merged_list(body: str, fixes: dict[str, str]) -> tuple[str, int]:
    """The fix list `body` with its automatic block replaced by fixes (sorted; those that a human rule is for are left out), and how many of them are new. What
    the old block had and fixes doesn't goes."""
    mine = {k: v for k, v in fixes.items() if k not in human_phrases(body)}
    old = {m[1] for b in _BLOCK.findall(body) for m in _ENTRY.finditer(b)}
    rest = _BLOCK.sub("", body).rstrip()
    lines = ([rest, ""] if rest else []) + ([] if "[phrase]" in rest else ["[phrase]"])
    lines += [BEGIN, *[f"{toml_string(k)} = {toml_string(mine[k])}" for k in sorted(mine)], END, ""]
    return "\n".join(lines), sum(_raw(k) not in old for k in mine)


def write_whole(path: str, text: str) -> None:
    """Write a local file of the driver so that a reader sees the old one or the new one."""
    fd, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def fingerprint(content: Column) -> Column:
    """SHA-256 of a file's size and of its first and last 4 MiB, or of all where it is no larger than 8."""
    part, size = 4 << 20, F.octet_length(content)
    ends = F.concat(F.substring(content, 1, part), F.substring(content, -part, part))
    body = F.when(size > 2 * part, ends).otherwise(content)
    return F.sha2(F.concat(F.unhex(F.lpad(F.hex(size.cast("long")), 16, "0")), body), 256)


def epubcheck_state(messages: Column, ran: Column) -> Column:
    """ok, warn or fail by the worst severity of a checker's messages (ARRAY<STRUCT<severity, ...>>), unavailable where it did not run."""
    bad = F.exists(messages, lambda m: m.severity.isin("ERROR", "FATAL"))
    warn = F.exists(messages, lambda m: m.severity == "WARNING")
    return F.when(~F.coalesce(ran, F.lit(False)), "unavailable").when(bad, "fail").when(warn, "warn").otherwise("ok")
