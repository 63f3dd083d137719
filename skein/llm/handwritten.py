"""Telling hand-written source from generated, minified, vendored files and data.

The evidence is how a file names things, held against character n-gram models of
each language, in which each file weighs the same however much it holds:

* ``entropy``, ``token_entropy`` - mean bits a character of its distinct names, and
  of all its words and numbers, under the trigram model of the language's names.
  Above what the language's files usually have: the names are mangled (minified or
  bundled code), or the file holds more data than names.
* ``diversity`` - how many different first or last words its function names amount
  to, beside what as many names drawn from the language's words would.  Low: the
  names are stamped from a template.
* ``form`` - mean bits of its function names under a trigram model of name forms, a
  form being the sequence of words, numbers and leading underscores.  Above what the
  language usually has: a foreign naming style, so a copy of somebody else's library.
  The form model is trained twice, the second time without the files the first sets
  apart, so that what is foreign does not teach it.

Texts are read once: a pass over them leaves, of every file, sparse trigram counts
and figures of its function names, and, of every task, its share of the name model
(at most 39^3 counts a language, a bound that lets the model be broadcast).  Medians
and word counts of a language with few files lean on those of all files, by
``lean_files`` files' worth.  Comments are blanked first, language by language, so a
file that merely speaks of generators or licences shows nothing of it.

Defined results: several rows of a file are judged apart and the file is flagged
if any is; null content, empty content and content without words give no evidence
and are not flagged; unknown or null languages form one of their own; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.languages import without_comments
from skein.workspace import materialise, ship

SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789_^$"
FORMS = "w#_^$"  # a word, a number, a leading underscore, begin and end
LANGUAGES = ("typescript", "tsx", "python", "go", "php", "bash")
_TOKEN = re.compile(r"[A-Za-z0-9_]+")
_FUNCTION = re.compile(r"\b(?:function|def|func)\s+(?:\([^)\n]*\)\s*)?([A-Za-z_]\w*)|^([A-Za-z_]\w*)\(\)\s*\{", re.M)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_UNIT = 1_000_000  # weight of a file
_AT_ONCE = 500  # files whose figures a worker holds
_FIGURES = "functions int, first_words double, last_words double, end_line int"


@dataclass(frozen=True)
class Limits:
    """When a profile is evidence."""

    entropy_over_median: float = 1.4
    token_entropy_over_median: float = 1.6
    diversity: float = 0.4
    form_set_apart: float = 2.75
    form_over_median: float = 5.0
    lean_files: int = 10


def _codes(symbols: str) -> np.ndarray:
    codes = np.full(256, len(symbols), np.int64)
    for i, c in enumerate(symbols):
        codes[ord(c)] = i
    return codes


_NAME_CODES, _FORM_CODES = _codes(SYMBOLS), _codes(FORMS)


def trigrams(words: list[str], symbols: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of padded words as numbers, and how often each occurs."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(symbols)
    c = codes[np.frombuffer(("^^" + "$^^".join(words) + "$").lower().encode(), np.uint8)]
    inside = c[2:] != symbols.index("^")
    return np.unique(((c[:-2] * n + c[1:-1]) * n + c[2:])[inside], return_counts=True)


def effective(values: list) -> float:
    """Exponential of the entropy: how many equally frequent values it amounts to."""
    k = np.fromiter(Counter(values).values(), float)
    k /= k.sum()
    return math.exp(-(k * np.log(k)).sum())


def name_words(name: str) -> list[str]:
    """Words of an identifier; a leading underscore and numbers count as words."""
    out = ["_"] if name.startswith("_") else []
    return out + ["#" if w.isdigit() else w.lower() for w in _WORDS.findall(name)]


def form_of(words: list[str]) -> str:
    return "".join(w if w in "_#" else "w" for w in words)


def bits_of(weights: np.ndarray, n: int, each: float = 0.05) -> np.ndarray:
    """Bits of each trigram given its first two symbols, from smoothed weights."""
    table = weights.reshape(-1, n, n, n)
    return -np.log2((table + each) / (table.sum(axis=3, keepdims=True) + each * n)).reshape(len(table), -1)


def read_file(content: str | None, lang: str | None) -> dict:
    """What a pass over one text leaves of it."""
    text = without_comments(content, (lang or "").strip().lower()) if content else ""
    tokens = _TOKEN.findall(text)
    names = [x for x in dict.fromkeys(tokens) if not x[0].isdigit()]
    stamped = [w for w in (name_words(a or b) for a, b in _FUNCTION.findall(text)) if w]
    first, last = [w[0] for w in stamped], [w[-1] for w in stamped]
    out = {"functions": len(stamped), "first": first, "last": last, "end_line": content.count("\n") + 1 if content is not None else None}
    out["first_words"], out["last_words"] = (effective(first), effective(last)) if stamped else (0.0, 0.0)
    for kind, (at, n) in {
        "name": trigrams(names, SYMBOLS, _NAME_CODES),
        "token": trigrams(tokens, SYMBOLS, _NAME_CODES),
    }.items():
        out[kind], out[f"{kind}_n"] = at.astype(np.int32), n.astype(np.int32)
    at, n = trigrams([form_of(w) for w in stamped], FORMS, _FORM_CODES)
    out["form"], out["form_n"] = at.tolist(), n.tolist()
    return out


def _language(c: Column) -> Column:
    known = F.lit(len(LANGUAGES))
    for i, name in enumerate(LANGUAGES):
        known = F.when(F.lower(F.trim(c)) == name, i).otherwise(known)
    return known


def _read(files: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """One row a file, and the name model's weights (language, gram, weight) task by task."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema)
    packed = ["name", "name_n", "token", "token_n"]  # 32-bit numbers
    arrays = "first array<string>, last array<string>, form array<int>, form_n array<int>, " + ", ".join(f"{x} binary" for x in packed)
    figures = [*(x.split()[0] for x in f"{arrays}, {_FIGURES}".split(", "))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((len(LANGUAGES) + 1, len(SYMBOLS) ** 3), np.int64)
        for batch in (b.iloc[at : at + _AT_ONCE] for b in batches for at in range(0, len(b), _AT_ONCE)):
            rows = [read_file(c, lang) for c, lang in zip(batch["content"], batch["lang"])]
            for language, row in zip(batch["language"], rows):
                if len(row["name"]):
                    held[language, row["name"]] += row["name_n"] * _UNIT // row["name_n"].sum()
            out = pd.DataFrame({k: pd.Series([r[k].tobytes() if k in packed else r[k] for r in rows], index=batch.index, dtype=object) for k in figures})
            yield pd.concat([batch[[*keep, "language"]], out], axis=1).assign(gram=None, weight=None)
        language, gram = np.nonzero(held)
        if len(gram):
            model = pd.DataFrame({"language": language, "gram": gram, "weight": held[language, gram]})
            yield model.assign(**dict.fromkeys([*keep, *figures]))[[*keep, "language", *figures, "gram", "weight"]]

    rows = materialise(
        files.select(*keep, "content", "lang", _language(F.col("lang")).alias("language"))
        .mapInPandas(read, f"{schema}, language int, {arrays}, {_FIGURES}, gram int, weight bigint"),
        "names",
    )
    return rows.where("gram is null").drop("gram", "weight"), rows.where("gram is not null").select("language", "gram", "weight")


def _dense(weights: DataFrame, languages: int, size: int) -> np.ndarray:
    """Weights (language, gram, weight), at most ``languages`` times ``size``, as an array."""
    rows = weights.toArrow()
    table = np.zeros((languages, size))
    table[rows["language"].to_numpy(), rows["gram"].to_numpy()] = rows["weight"].to_numpy() / _UNIT
    return table


def _leaning(own: dict[int, tuple[float, float]], overall: float | None, lean: int) -> Column:
    """Per language the mean of its value, (weight, value), and ``lean`` times the overall one."""
    values = []
    for i in range(len(LANGUAGES) + 1):
        n, x = own.get(i, (0.0, None))
        values.append(None if overall is None else overall if x is None else (x * n + overall * lean) / (n + lean))
    return F.element_at(F.array(*[F.lit(v).cast("double") for v in values]), F.col("language") + 1)


def _usual(profiles: DataFrame, columns: list[str], lean: int) -> dict[str, Column]:
    """Medians of ``columns`` per language, leaning on those of all files."""
    medians = [F.percentile_approx(c, 0.5, 10_000).alias(c) for c in columns]
    rows = profiles.rollup("language").agg(*medians, *[F.count(c).alias(f"{c}_files") for c in columns]).collect()  # a row a language and one
    overall = next((r for r in rows if r["language"] is None), None)
    own = lambda c: {r["language"]: (r[f"{c}_files"], r[c]) for r in rows if r["language"] is not None}
    return {c: _leaning(own(c), overall[c] if overall else None, lean) for c in columns}


def _vocabulary(files: DataFrame, lean: int) -> dict[str, Column]:
    """Per language how many equally frequent first and last words its function names
    amount to, each file weighing the same; leaning on those of all files."""
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("end"), F.col(k).alias("words")) for k in ("first", "last")]))
    named = files.where("functions > 0").select("language", (F.lit(1.0) / F.col("functions")).alias("w"), ends.alias("e"))
    counted = named.select("language", "w", "e.end", F.explode("e.words").alias("word")).rollup("end", "word", "language").agg(F.sum("w").alias("w"))
    rows = (
        counted.where("word is not null").groupBy("end", "language")
        .agg(F.sum("w").alias("n"), (F.log(F.sum("w")) - F.sum(F.col("w") * F.log("w")) / F.sum("w")).alias("size"))
        .collect()  # two rows a language and two
    )
    overall = {r["end"]: r["size"] for r in rows if r["language"] is None}
    own = lambda end: {r["language"]: (r["n"], r["size"]) for r in rows if r["end"] == end and r["language"] is not None}
    return {end: F.exp(_leaning(own(end), overall.get(end), lean)) for end in ("first", "last")}


def _with_forms(profiles: DataFrame, learn: Column, lean: int) -> DataFrame:
    """``profiles`` plus ``form``, under a model of the rows that ``learn``, and its usual value."""
    spark, n = profiles.sparkSession, len(FORMS)
    pairs = F.arrays_zip(F.col("form_grams").alias("gram"), F.col("form_n").alias("n"))
    learnt = (
        profiles.where(learn & (F.col("functions") > 0))
        .select("language", "functions", F.explode(pairs).alias("p"))
        .groupBy("language", F.col("p.gram").alias("gram"))
        .agg(F.sum(F.col("p.n") * F.lit(_UNIT) / F.col("functions")).alias("weight"))
    )
    bits = bits_of(_dense(learnt, len(LANGUAGES) + 1, n**3), n)
    table = spark.createDataFrame([(i, [float(x) for x in b]) for i, b in enumerate(bits)], "language int, bits array<double>")
    total = F.aggregate(F.zip_with("form_grams", "form_n", lambda g, k: F.element_at("bits", g + 1) * k), F.lit(0.0), lambda a, x: a + x)
    scored = profiles.join(F.broadcast(table), "language").withColumn("form", F.when(F.col("functions") > 0, total / F.col("functions"))).drop("bits")
    return scored.withColumn("usual_form", _usual(scored, ["form"], lean)["form"])


def judge_files(files: DataFrame, limits: Limits = Limits(), keep: tuple[str, ...] = ("project", "relpath")) -> DataFrame:
    """Profiles of ``files`` (keep..., lang, content) with ``reasons``, an array
    of mangled, data, template and foreign."""
    spark = files.sparkSession
    ship(spark)
    read, model = _read(files, keep)
    grams = model.groupBy("language", "gram").agg(F.sum("weight").alias("weight"))
    shared = spark.sparkContext.broadcast(bits_of(_dense(grams, len(LANGUAGES) + 1, len(SYMBOLS) ** 3), len(SYMBOLS), 0.005).astype(np.float32))

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value

        def mean(lang: int, at: bytes, n: bytes) -> float | None:
            k = np.frombuffer(n, np.int32)
            return float((bits[lang][np.frombuffer(at, np.int32)] * k).sum() / k.sum()) if len(k) else None

        for b in batches:
            yield b.drop(columns=["name", "name_n", "token", "token_n"]).assign(
                entropy=[mean(*x) for x in zip(b["language"], b["name"], b["name_n"])], token_entropy=[mean(*x) for x in zip(b["language"], b["token"], b["token_n"])]
            )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name not in ("first", "last", "name", "name_n", "token", "token_n")]
    profiles = materialise(
        read.drop("first", "last").mapInPandas(weighed, ", ".join(kept) + ", entropy double, token_entropy double").withColumnRenamed("form", "form_grams"), "profiles"
    )
    usual = _usual(profiles, ["entropy", "token_entropy"], limits.lean_files)
    sizes = _vocabulary(read, limits.lean_files)
    drawn = lambda k: sizes[k] * (1 - F.exp(-F.col("functions") / sizes[k]))
    over = lambda c, limit: F.col(c) > F.col(f"usual_{c}") + limit
    known = (
        profiles.withColumns({f"usual_{c}": value for c, value in usual.items()})
        .withColumn("diversity", F.when(F.col("functions") > 0, F.least(F.col("first_words") / drawn("first"), F.col("last_words") / drawn("last"))))
        .withColumn("mangled", F.coalesce(over("entropy", limits.entropy_over_median), F.lit(False)))
        .withColumn("data", F.coalesce(over("token_entropy", limits.token_entropy_over_median), F.lit(False)))
        .withColumn("template", F.coalesce(F.col("diversity") <= limits.diversity, F.lit(False)))
    )
    plain = ~(F.col("mangled") | F.col("data") | F.col("template"))
    first = _with_forms(known, plain, limits.lean_files).withColumn("apart", F.coalesce(over("form", limits.form_set_apart), F.lit(False))).drop("form", "usual_form")
    judged = _with_forms(first, plain & ~F.col("apart"), limits.lean_files)
    reasons = F.array(
        F.when(F.col("mangled"), "mangled"), F.when(F.col("data") & ~F.col("mangled"), "data"), F.when(F.col("template"), "template"),
        F.when(plain & over("form", limits.form_over_median), "foreign"),
    )
    out = [*keep, "language", "end_line", "functions", "entropy", "usual_entropy", "token_entropy", "usual_token_entropy", "diversity", "form", "usual_form"]
    return judged.select(*out, F.array_compact(reasons).alias("reasons"))


def not_handwritten(judged: DataFrame, keep: tuple[str, ...] = ("project", "relpath")) -> DataFrame:
    """The files that any of their rows shows not to be hand-written."""
    return judged.where(F.size("reasons") > 0).select(*keep).distinct()
