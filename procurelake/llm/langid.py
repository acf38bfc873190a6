"""Language identification by Bayesian evidence fusion (operator 8).

Four kinds of evidence about a page's language are multiplied: the likelihood of its text under character
trigram models, the language its markup declares, the suffix of its address, and a prior for its host that
is smoothed towards its domain's and that towards the prior of all pages. How far each declaration, suffix
or host can be trusted is learnt from the pages themselves by grouped aggregation of what their texts say.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.shared import append_columns, apart, quoted, stash, text_or_empty, unused
from procurelake.llm.url_filter import url_parts
from procurelake.llm.words import mix

#: Hash buckets of trigrams as a power of two, and the pseudo-count of each.
BITS, PSEUDO = 16, 0.5
#: Weight of a level's parent in the smoothing of priors, in pages; and of the overall share in the confusion tables.
PARENT, DECLARED = 5.0, 2.0
#: Languages whose models are broadcast together (16 MB).
LANGUAGES = 64


def trigrams(text: str) -> np.ndarray:
    """Hash buckets of the lower-cased text's character trigrams, spaces around it included."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, np.int64)
    return (mix(c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42)) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def fit_languages(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by language and bucket), from the trigram counts of all texts with a language.

    Texts without one are left out, null texts count as empty, repeated rows count each; languages are in
    alphabetical order. An empty table has no languages.
    """
    sent = df.select(text_or_empty(text).alias("text"), F.col(quoted(lang)).alias("lang")).where(F.col("lang").isNotNull())

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if k not in counts:
                    counts[k] = np.zeros(1 << BITS, np.int64)
                counts[k] += np.bincount(trigrams(t.as_py()), minlength=1 << BITS)
        for k, n in counts.items():
            places = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(places), pa.string()), pa.array(places), pa.array(n[places])], names=["lang", "place", "n"])

    counted = sent.mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    names, logs = [], []
    totals = np.full(1 << BITS, PSEUDO)
    for r in stash(counted, "trigrams").orderBy("lang").toLocalIterator():  # at most 2^16 rows a language, one language after the other
        if not names or names[-1] != r.lang:
            if names:
                logs.append(np.log(totals / totals.sum()).astype("<f4"))
            names.append(r.lang)
            totals = np.full(1 << BITS, PSEUDO)
        totals[r.place] += r.n
    if names:
        logs.append(np.log(totals / totals.sum()).astype("<f4"))
    # a language of which no text has a trigram says the same of all texts
    silent = [r.lang for r in sent.select("lang").distinct().collect() if r.lang not in {*names}]
    rows = dict(zip(names, logs, strict=True)) | {k: np.full(1 << BITS, -BITS * np.log(2), "<f4") for k in silent}
    return sorted(rows), np.stack([rows[k] for k in sorted(rows)]) if rows else np.zeros((0, 1 << BITS), "<f4")


def page_text(html):
    """The text between the tags, scripts, styles and comments left out."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[a-zA-Z#0-9]{1,8};", " ")


def softmax(logs, n: int):
    top = F.array_max(logs)
    parts = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))


def sums(column: str, n: int, name: str):
    return F.array(*[F.sum(F.col(column)[i]) for i in range(n)]).alias(name)


def identify(df: DataFrame, languages: list[str], table: np.ndarray, *, url: str = "url", html: str = "html") -> DataFrame:
    """``df`` without its html, with host, declared, text_lang, lang and confidence appended (columns of these names are replaced).

    ``lang`` has the largest posterior, ties going to the first in alphabetical order; ``text_lang`` is what
    the text alone says. Null or empty pages have no text evidence and rest on the other kinds; null urls
    share the empty host. A row's own text does not count in its host's prior. Repeated rows are judged
    each; whole pages are read; an empty table stays empty, and without languages both results are null.
    """
    n = len(languages)
    host, _ = url_parts(F.col(quoted(url)))
    declared = F.lower(F.regexp_extract(F.col(quoted(html)), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    outs = ["host", "declared", "text_lang", "lang", "confidence"]
    names = {*outs, html.lower()}
    if not n:
        keep = [F.col(quoted(c)) for c in df.columns if c.lower() not in names]
        return df.select(*keep, host.alias("host"), declared.alias("declared"), *[F.lit(None).cast("string").alias(c) for c in outs[2:4]], F.lit(None).cast("double").alias("confidence"))

    def scorer(block: np.ndarray):
        broad = df.sparkSession.sparkContext.broadcast(block)

        def make():
            logs = broad.value.astype(np.float64)

            def compute(texts: pa.Array):
                out = []
                for t in texts:
                    places = trigrams((t.as_py() or "").strip())
                    # neighbouring trigrams repeat each other's evidence: it grows with the root of the length
                    out.append((logs[:, places].sum(1) / np.sqrt(max(1, len(places)))).tolist())
                return [pa.array(out, pa.list_(pa.float64()))]

            return compute

        return make

    parts = F.split("host", r"\.")
    # the columns that pass through travel as one, so that none meets a name of this function's own
    passed = F.struct(*[F.col(quoted(c)) for c in df.columns if c.lower() not in names], F.lit(None).cast("int").alias(unused(df, "none"))).alias("row")
    ready = df.select(passed, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(declared, F.lit("")).alias("declared"), page_text(F.col(quoted(html))).alias("text"))
    # a model of LANGUAGES languages is broadcast at a time; each writes what it makes of the texts before the next
    starts, scored = range(0, n, LANGUAGES), ready
    for k, lo in enumerate(starts):
        last = k == len(starts) - 1
        scored = append_columns(scored, ["text"], [T.StructField(f"logs{k}", T.ArrayType(T.DoubleType()))], scorer(table[lo : lo + LANGUAGES]), drop=["text"] if last else [])
        scored = scored if last else stash(scored, "logs")
    scored = scored.withColumn("logs", F.concat(*[F.col(f"logs{k}") for k in range(len(starts))])).drop(*[f"logs{k}" for k in range(len(starts))])
    known = F.when(F.col("declared").isin(*languages), F.col("declared")).when(F.col("declared") == "", "").otherwise("other")
    scored = scored.withColumn("post", softmax(F.col("logs"), n)).withColumn("said", known)
    scored = stash(scored, "pages")

    # what the texts say, by declaration (a bounded number of them), host, domain and suffix
    said = {r["said"]: r["sums"] for r in scored.groupBy("said").agg(sums("post", n, "sums")).collect()}
    total = np.sum(list(said.values()), axis=0) if said else np.ones(n)
    share = total / total.sum()
    trust = {}
    for value, counts in said.items():
        of_all = sum(counts) / total.sum()
        trust[value] = np.log((np.array(counts) + DECLARED * of_all) / (total + DECLARED))
    hosts = scored.groupBy("host").agg(sums("post", n, "host_sums"), F.count("*").alias("host_n"))
    hosts = hosts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.element_at(parts, -1))
    domains = hosts.groupBy("domain").agg(sums("host_sums", n, "domain_sums"), F.sum("host_n").alias("domain_n"))
    suffixes = hosts.groupBy("suffix").agg(sums("host_sums", n, "suffix_sums"))
    # domains and suffixes that very many hosts share (com) are split by the joins
    hosts = hosts.join(apart(domains, "domain"), "domain").join(apart(suffixes, "suffix"), "suffix").drop("domain", "suffix")
    judged = scored.join(apart(hosts, "host"), "host")

    def fused(i: int):
        own = F.col("post")[i]
        domain = (F.col("domain_sums")[i] - own + PARENT * float(share[i])) / (F.col("domain_n") - 1 + PARENT)
        prior = (F.col("host_sums")[i] - own + PARENT * domain) / (F.col("host_n") - 1 + PARENT)
        suffix = (F.col("suffix_sums")[i] - own + DECLARED * float(share[i])) / (float(total[i]) - own + DECLARED)
        word = F.create_map(*[F.lit(x) for v, t in trust.items() for x in (v, float(t[i]))])[F.col("said")] if trust else F.lit(0.0)
        return F.col("logs")[i] + F.log(F.greatest(prior, F.lit(1e-12))) + F.log(F.greatest(suffix, F.lit(1e-12))) + word

    spelled = F.array(*[F.lit(x) for x in languages])
    judged = judged.withColumn("all", softmax(F.array(*[fused(i) for i in range(n)]), n))
    pick = lambda c: F.element_at(spelled, F.array_position(c, F.array_max(c)).cast("int"))
    return judged.select(*[F.col("row")[c].alias(c) for c in df.columns if c.lower() not in names], "host", "declared", pick(F.col("post")).alias("text_lang"), pick(F.col("all")).alias("lang"), F.array_max("all").alias("confidence"))


def op8_langid(spark, sf_dir: str) -> DataFrame:
    """Language of every page; the trigram models come from all documents."""
    languages, table = fit_languages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return identify(pages, languages, table).select("page_id", "host", "declared", "text_lang", "lang", F.round("confidence", 6).alias("confidence"))
