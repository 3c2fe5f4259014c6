"""Operator 8: license scans by MinHash bands over overlapping windows, DataFrame functions only.

A template of n words with S distinct shingles (of min(5, n) words) is looked for in windows
of n + stride - 1 words that start every `stride` words, stride = max(1, n / 4): some window
holds any occurrence whole.  A window matches if it contains at least `percent` of the
template's shingles; its similarity is then at least a known j, and the number of bands of
two MinHash rows is the least with 1 - (1 - j^2)^bands >= `recall`.  Windows that share a band
with a template of their width are verified exactly.

Most texts leave before that: of each template some words are chosen that stand in so many
of its shingles that a window without any of them can't match.  A text without any such
word is skipped by one regular expression; nothing can be lost.

Templates are few: their shingles, signatures and words are computed as a DataFrame, and the
bands are broadcast only while there are at most 100,000 of them (a shuffled join otherwise).

Words: A-Z in lower case, every run of characters other than letters and digits is one space.
Edge cases: null, empty and short texts match nothing; repeated rows yield one row for each
(doc_id, license); a null doc_id is reported as such; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# License lines to look for.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
]


def words_of(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def plain_words(text: str) -> list[str]:
    """The same for a template, on the driver."""
    return "".join(c.lower() if c.isascii() else c if c.isalnum() else " " for c in (x if x.isalnum() else " " for x in text)).split()


def shingles_of(words: Column, k: Column) -> Column:
    """Distinct runs of k words as strings; none if there are fewer."""
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " ")))


def shape(words: list[str], k: int, percent: int, recall: float) -> dict:
    """Stride, window width, least contained shingles and bands of a template."""
    n, size = len(words), min(k, len(words))
    distinct = len({tuple(words[i : i + size]) for i in range(n - size + 1)})
    stride = max(1, n // 4)
    width = n + stride - 1
    least = math.ceil(distinct * percent / 100)
    j = least / (width - size + 1 + distinct - least)
    bands = 1 if j >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - j * j))
    return {"n_words": n, "k": size, "n_shingles": distinct, "stride": stride, "width": width, "least": least, "bands": bands}


def anchors(words: list[str], k: int, least: int) -> set[str]:
    """Words without which fewer than `least` of the template's distinct shingles remain; long words first."""
    size = min(k, len(words))
    left = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    chosen = set()
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(left) < least:
            break
        if any(w in s for s in left):
            chosen.add(w)
            left = {s for s in left if w not in s}
    return chosen


def signature(shingles: Column, bands: Column) -> Column:
    """Hash of each band: the least hash of the shingles under two seeds."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.xxhash64(b, F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, 2 * b))), F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, 2 * b + 1)))))


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: a generated column is not put in for its uses again."""
    return df.withColumn(name, F.explode(F.array(value)))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, k: int = 5, percent: int = 80, recall: float = 0.999) -> DataFrame:
    """doc_id, license, containment (of the best window), word_start (0-based, of the first best window)."""
    spark: SparkSession = docs.sparkSession
    known = [(name, text, plain_words(text)) for name, text in (TEMPLATES if templates is None else templates)]
    known = [(name, text, words, shape(words, k, percent, recall)) for name, text, words in known if words]
    if not known:
        return spark.createDataFrame([], "doc_id long, license string, containment double, word_start int")
    anchor = sorted(set().union(*(anchors(words, k, s["least"]) for _, _, words, s in known)))
    template = spark.createDataFrame([(name, text, *s.values()) for name, text, _, s in known], "license string, template string, n_words int, k int, n_shingles int, stride int, width int, least int, bands int")
    template = template.withColumn("wanted", shingles_of(words_of(F.col("template")), F.col("k")))
    bands = template.select("license", "width", "stride", "k", "least", "n_shingles", "wanted", F.posexplode(signature(F.col("wanted"), F.col("bands"))).alias("band", "hash"))
    n_bands = sum(s["bands"] for *_, s in known)
    forms = sorted({(s["k"], s["stride"], s["width"], s["bands"]) for *_, s in known})
    form = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("k", "stride", "width", "bands"), f))) for f in forms))
    maybe = docs.select("doc_id", "text").where(F.col("text").rlike("(?i)" + "|".join(map(re.escape, anchor))))
    split = held(maybe, "words", words_of(F.col("text"))).select("doc_id", "words").where(F.size("words") > 0)
    # only windows around an anchor can match; the others aren't made
    spots = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(anchor))
    spots = held(split, "spots", spots).where(F.size("spots") > 0)

    def windows(f: Column) -> Column:
        k, stride, width, bands = (f[n] for n in ("k", "stride", "width", "bands"))
        last = F.floor(F.greatest(F.lit(0), F.size("words") - width + stride - 1) / stride)
        first = lambda i: F.greatest(F.lit(0), F.ceil((i - width + 1) / stride))
        final = lambda i: F.least(last, F.floor(i / stride))
        starts = F.array_distinct(F.flatten(F.transform("spots", lambda i: F.when(first(i) <= final(i), F.sequence(first(i), final(i))).otherwise(F.array().cast("array<bigint>")))))
        return F.transform(starts, lambda n: F.struct((n * stride).cast("int").alias("word_start"), F.slice("words", (n * stride + 1).cast("int"), width).alias("words"), k.alias("k"), stride.alias("stride"), width.alias("width"), bands.alias("bands")))

    window = spots.select("doc_id", F.explode(F.flatten(F.transform(form, windows))).alias("w")).select("doc_id", "w.*")
    window = held(window, "has", shingles_of(F.col("words"), F.col("k"))).where(F.size("has") > 0)
    hashed = window.select("doc_id", "word_start", "has", "width", "stride", "k", F.posexplode(signature(F.col("has"), F.col("bands"))).alias("band", "hash"))
    found = hashed.join(F.broadcast(bands) if n_bands <= 100_000 else bands, ["width", "stride", "k", "band", "hash"])
    share = found.select("doc_id", "license", "word_start", F.size(F.array_intersect("has", "wanted")).alias("hits"), "least", "n_shingles").where("hits >= least")
    best = share.groupBy("doc_id", "license").agg(F.min(F.struct((-F.col("hits")).alias("hits"), "word_start", "n_shingles")).alias("best"))
    return best.select("doc_id", "license", (-F.col("best.hits") / F.col("best.n_shingles")).alias("containment"), F.col("best.word_start").alias("word_start"))


def oracle(templates: list[tuple[str, str]] | None = None, k: int = 5, percent: int = 80) -> str:
    """The same by brute force over all windows, in DuckDB's SQL."""
    known = [(name, plain_words(text)) for name, text in (TEMPLATES if templates is None else templates)]
    values = []
    for name, words in known:
        s = shape(words, k, percent, 0.999)
        shingle = sorted({" ".join(words[i : i + s["k"]]) for i in range(s["n_words"] - s["k"] + 1)})
        values.append(f"('{name}', {s['k']}, {s['stride']}, {s['width']}, {s['least']}, {shingle!r})")
    return rf"""
        WITH template(license, k, stride, width, least, wanted) AS (VALUES {', '.join(values)}),
        split AS (
            SELECT doc_id, list_filter(string_split(regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS words
            FROM documents
        ), windows AS (
            SELECT doc_id, license, k, least, wanted, start AS word_start, words[start + 1 : start + width] AS words
            FROM (SELECT *, unnest(generate_series(0, greatest(0, len(words) - width + stride - 1), stride)) AS start FROM split CROSS JOIN template WHERE len(words) > 0)
        ), hits AS (
            SELECT doc_id, license, least, len(wanted) AS n_shingles, word_start,
                   len(list_filter(wanted, lambda s: list_contains(list_transform(generate_series(1, len(words) - k + 1), lambda i: array_to_string(words[i : i + k - 1], ' ')), s))) AS hits
            FROM windows
        )
        SELECT doc_id, license, max(hits)::DOUBLE / any_value(n_shingles) AS containment, (arg_min(word_start, (-hits * 1000000000 + word_start)))::INTEGER AS word_start
        FROM hits WHERE hits >= least GROUP BY doc_id, license
    """
