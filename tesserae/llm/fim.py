"""Fill-in-middle transformation by escaped marker injection.

A text is cut into units (a run of white space with the word after it, or the white space at its end). All of it is column
expressions: the character ``MARK`` is escaped, so that it occurs nowhere; ``regexp_replace`` appends it after each unit; the
marks are counted; ``substring_index`` takes the text up to the first and second cut, which are ranks of marks; what lies between and
after is the rest. Pieces lose their marks and are unescaped, and are assembled around the markers of the form.

Escaping turns a character that isn't white space into two that aren't, so units stay what they are. Markers can't arise across
pieces, since each begins with the only ``<`` and ends with the only ``>`` in it; so a text without markers is rebuilt from its output and form alone.

A document's draws follow from its key alone: the first four groups of eight hex digits of the SHA-256 of ``seed:key``.

Nulls and edge cases: null texts count as empty; empty texts and those that hold a marker are plain; a null key draws as the text
``null``; texts of blanks are one unit; long texts are cut whole; repeated rows give equal rows; an empty table gives an empty
result; columns of the input stay, but those named as one of ``ADDED`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The unit's pattern, the markers of prefix, suffix and middle.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Marks a unit's end; written ESCAPE + "a" in the text, and ESCAPE as ESCAPE + "b".
MARK, ESCAPE = "\x01", "\x02"
#: More characters than any string has.
REST = 2**31 - 1
RATE, SPM_RATE, SEED = 50, 80, "42"
ADDED = ("n", "form", "prefix", "middle", "suffix", "output")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}b")), F.lit(MARK), F.lit(f"{ESCAPE}a"))


def unescaped(piece: Column) -> Column:
    """A piece of a marked text as it was. Escapes are read back in the other order: no ``ESCAPE`` is left over that could begin another."""
    return F.replace(F.replace(F.replace(piece, F.lit(MARK), F.lit("")), F.lit(f"{ESCAPE}a"), F.lit(MARK)), F.lit(f"{ESCAPE}b"), F.lit(ESCAPE))


def draw(key: Column, k: int, seed: str = SEED) -> Column:
    """The k-th number (from 0) that a document draws, 0 to 2 ** 32 - 1."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")


def _after(text: Column, head: Column, skip: int = 0) -> Column:
    """What follows ``head``, which ``text`` begins with, and ``skip`` characters more."""
    return F.substring(text, F.length(head) + 1 + skip, F.lit(REST))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED) -> DataFrame:
    """The input with the number of units, the form (plain, psm or spm), the pieces (null if plain) and the output.

    ``rate`` percent of documents that may be are transformed, ``spm_rate`` percent of these with the suffix first.
    """
    rows = docs.drop(*ADDED).withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    marked = rows.withColumn("_m", F.regexp_replace(escaped(F.col("_t")), UNIT, f"$0{MARK}"))
    counted = marked.withColumn("n", (F.octet_length("_m") - F.octet_length(F.replace("_m", F.lit(MARK), F.lit("")))).cast("long"))
    one, other = (F.pmod(draw(F.col(key), k, seed), F.col("n") + 1) for k in (0, 1))
    drawn = counted.withColumns({"_a": F.least(one, other).cast("int"), "_b": F.greatest(one, other).cast("int")})
    has_marker = F.contains("_t", F.lit(PREFIX)) | F.contains("_t", F.lit(SUFFIX)) | F.contains("_t", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | has_marker | (draw(F.col(key), 2, seed) % 100 >= rate)
    formed = drawn.withColumn("form", F.when(plain, "plain").when(draw(F.col(key), 3, seed) % 100 < spm_rate, "spm").otherwise("psm"))
    cut = formed.withColumn("_2", F.when(F.col("form") != "plain", F.expr(f"substring_index(_m, '{MARK}', _b)")))
    cut = cut.withColumn("_1", F.expr(f"substring_index(_2, '{MARK}', _a)"))
    pieces = cut.withColumns({"prefix": unescaped(F.col("_1")), "middle": unescaped(_after(F.col("_2"), F.col("_1"))), "suffix": unescaped(_after(F.col("_m"), F.col("_2")))})
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("_t")).when(F.col("form") == "spm", spm).otherwise(psm)
    return pieces.withColumn("output", output).drop("_t", "_m", "_a", "_b", "_1", "_2")


def restore(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``rows`` with ``restored``, the text that is rebuilt from an output and its form: pieces are found between the markers."""
    end = F.col("_first_end")
    head = rows.withColumn("_head", F.when(F.col(form) != "plain", F.substring_index(output, MIDDLE, 1)))
    first = head.withColumn("_first", F.when(F.col(form) == "psm", F.substring_index("_head", SUFFIX, 1)).otherwise(F.substring_index("_head", PREFIX, 1)))
    ends = first.withColumns({"_first_end": F.length("_first"), "_middle": _after(F.col(output), F.col("_head"), 3)})
    # each marker has three characters; first and second are the pieces in the order of the output
    one, two = F.substring("_first", F.lit(4), end), F.substring("_head", end + 4, F.lit(REST))
    text = F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", F.concat(one, "_middle", two)).otherwise(F.concat(two, "_middle", one))
    return ends.withColumn("restored", text).drop("_head", "_first", "_first_end", "_middle")


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = restore(transform(docs))
    return out.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
cuts AS (
  SELECT doc_id, t, u, len(u) AS n,
    least(('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1), ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1)) AS a,
    greatest(('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1), ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
pieces AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces
"""
