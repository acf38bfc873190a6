"""Fill-in-middle transformation (operator 12), in relations of units.

A text is cut into units, the matches of a pattern, of which prefix, middle and suffix have whole numbers. The
matches come in two levels, so that no text costs a row for every code point: the lengths of blocks of units
are exploded with their positions, and window sums over a text's blocks give the code points before each. Cut
requests are joined to the block that holds their unit; only these blocks are exploded into units, window sums
of the unit lengths run over them, and the requests are joined by unit ordinal. The offsets are aggregated per
document, joined back, and substrings make the output. All of it is DataFrame functions.

A document is known by id and text digest: rows equal in both have the same cuts, so no row number has to
survive the loss of an executor, and the texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procurelake.llm.shared import quoted, text_or_empty, unused

#: Units of a block; about the square root of half a text's units is least work, the value is not critical.
BLOCK = 40
#: A unit per code point.
CODE_POINT = r"(?s)."
#: The marks before prefix, suffix and middle; per cent of plain texts and of texts with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20


def hashed(id_col: str, k: int) -> Column:
    """The ``k``-th group of eight hex digits of the SHA-256 of ``1:`` and the id, as a number."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def blocks_of(text: Column, unit: str) -> Column:
    """The text's blocks of up to BLOCK units, in order; code points that no unit matches are units of their own."""
    if unit == CODE_POINT:
        return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.regexp_extract_all(text, F.lit(f"(?:{one_of(unit)}){{1,{BLOCK}}}+"), F.lit(0))


def one_of(unit: str) -> str:
    return unit if unit == CODE_POINT else f"(?>{unit}|(?s:.))"


def units_of(text: Column, unit: str) -> Column:
    return F.regexp_extract_all(text, F.lit(one_of(unit)), F.lit(0))


def n_units(text: Column, unit: str) -> Column:
    return (F.char_length(text) if unit == CODE_POINT else F.size(units_of(text, unit))).cast("long")


def cut_offsets(keyed: DataFrame, unit: str) -> DataFrame:
    """(id, sha, first_at, second_at): code points before the two cuts of each of ``keyed(id, sha, text, first, second)``.

    ``first`` and ``second`` are numbers of units; rows that are equal count once. A cut after the last unit
    is in no block and stays null. All relations are dealt out by id and digest once, while they are one
    small row per text (lengths of its blocks, the blocks with a cut); ordinals are compared as a residual
    condition of the joins, so that these do not deal out the exploded rows anew.
    """
    cut = keyed.select("id", "sha", "first", "second", blocks_of(F.col("text"), unit).alias("blocks"))
    numbered = F.transform("blocks", lambda b, k: F.struct(k.alias("k"), F.when((k == F.floor(F.col("first") / BLOCK)) | (k == F.floor(F.col("second") / BLOCK)), b).alias("block")))
    lean = cut.select("id", "sha", "first", "second", F.transform("blocks", lambda b: F.char_length(b)).alias("chars"), F.filter(numbered, lambda x: x["block"].isNotNull()).alias("held"))
    lean = lean.dropDuplicates(["id", "sha"])
    running = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")

    # code points before each block
    sizes = lean.select("id", "sha", F.posexplode("chars").alias("k", "chars"))
    before = F.coalesce(F.sum("chars").over(running(Window.partitionBy("id", "sha").orderBy("k"))), none)
    sizes = sizes.select("id", "sha", "k", before.alias("before"))
    requests = lean.select(F.col("id").alias("rid"), F.col("sha").alias("rsha"), F.posexplode(F.array("first", "second")).alias("which", "ordinal"))
    mine = (F.col("rid") == F.col("id")) & (F.col("rsha") == F.col("sha"))
    placed = requests.join(sizes, mine & (F.floor(F.col("ordinal") / BLOCK) - F.col("k") == 0)).select("rid", "rsha", "which", "ordinal", "before")

    # code points before each unit of the blocks that hold a cut
    held = lean.select("id", "sha", F.explode("held").alias("h"))
    units = held.select("id", "sha", "h.k", F.posexplode(units_of(F.col("h.block"), unit)).alias("i", "unit"))
    inside = F.coalesce(F.sum(F.char_length("unit")).over(running(Window.partitionBy("id", "sha", "k").orderBy("i"))), none)
    units = units.select("id", "sha", (F.col("k").cast("long") * BLOCK + F.col("i")).alias("u"), inside.alias("inside"))
    met = placed.join(units, mine & (F.col("ordinal") - F.col("u") == 0))
    at = lambda n, name: F.max(F.when(F.col("which") == n, F.col("before") + F.col("inside"))).alias(name)
    return met.groupBy("id", "sha").agg(at(0, "first_at"), at(1, "second_at"))


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, unit: str = CODE_POINT, out: str = "fim") -> DataFrame:
    """``df`` with ``out`` appended: struct(n, form, prefix_chars, middle_chars, output).

    ``n`` is the text's number of units: matches of ``unit`` from left to right, code points between them
    being units too. The prefix ends after the smaller, the middle after the larger of two unit counts that the hash of the
    id gives; the form is ``plain`` for empty texts, texts with one of the marks and one id in ten, else
    ``spm`` for a fifth and ``psm`` for the rest; lengths are in code points, null for plain. Null texts count
    as empty, a null id as an empty one; rows repeated with id and text have the same result; a text that is
    one unit or very long is no special case; other columns pass through whatever their names (one named
    ``out`` is replaced); an empty table stays empty.
    """
    own, mark = text_or_empty(text), {n: unused(df, n) for n in ("sha", "n", "form", "first", "second", "id", "met")}
    h = lambda k: hashed(id_col, k)
    n = n_units(own, unit)
    marked = F.col(mark["n"])
    plain = (F.length(own) == 0) | own.contains(PREFIX) | own.contains(SUFFIX) | own.contains(MIDDLE) | (h(3) % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(h(4) % 100 < SPM_BELOW, "spm").otherwise("psm")
    a, b = h(1) % (marked + 1), h(2) % (marked + 1)
    full = df.withColumns({mark["sha"]: F.unhex(F.sha2(own, 256)), mark["n"]: n, mark["form"]: form})
    full = full.withColumns({mark["first"]: F.least(a, b), mark["second"]: F.greatest(a, b)})
    cut = full.where(F.col(mark["form"]) != "plain").select(
        F.col(quoted(id_col)).cast("string").alias("id"), F.col(mark["sha"]).alias("sha"), own.alias("text"), F.col(mark["first"]).alias("first"), F.col(mark["second"]).alias("second")
    )
    offsets = cut_offsets(cut.withColumn("id", F.coalesce("id", F.lit(""))), unit)
    offsets = offsets.select(F.col("id").alias(mark["id"]), F.col("sha").alias(mark["met"]), F.struct("first_at", "second_at").alias(unused(full, "offsets")))
    met_id, met_sha, at = offsets.columns
    joined = full.join(offsets, (F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")) == F.col(met_id)) & (F.col(mark["sha"]) == F.col(met_sha)), "left")
    length = F.char_length(own).cast("long")
    first, second = F.coalesce(F.col(at)["first_at"], length), F.coalesce(F.col(at)["second_at"], length)
    is_plain = F.col(mark["form"]) == "plain"
    piece = lambda lo, hi: F.substring(own, (lo + 1).cast("int"), (hi - lo).cast("int"))
    prefix, middle, suffix = piece(F.lit(0), first), piece(first, second), piece(second, length)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    made = F.struct(
        marked.alias("n"), F.col(mark["form"]).alias("form"),
        F.when(~is_plain, first).alias("prefix_chars"), F.when(~is_plain, second - first).alias("middle_chars"),
        F.when(is_plain, own).when(F.col(mark["form"]) == "spm", spm).otherwise(psm).alias("output"),
    )
    return joined.select(*[F.col(quoted(c)) for c in df.columns if c.lower() != out.lower()], made.alias(out))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from: its parts lie between the first of each mark, in the order of the form."""
    p, s, m = (F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    between = lambda lo, hi: F.substring(output, lo + 3, hi - lo - 3)
    rest = F.substring(output, m + 3, F.length(output))
    psm = F.concat(between(p, s), rest, between(s, m))
    spm = F.concat(between(p, m), rest, between(s, p))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every document cut by code points; digests of the output and of the text rebuilt from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs).select("doc_id", "fim.*")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


ORACLE = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2, ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM h),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                        ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
