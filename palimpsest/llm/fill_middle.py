"""Fill-in-middle transformation by markers: every unit of a text gets one behind it, and parts are read off by their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import fill_partitions

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The marker, and the character that escapes it: "0" behind it stands for itself, "1" for the marker. No letter, so units stay what they are.
_MARK, _ESC = "\x01", "\x02"
_UNIT = f"[A-Za-z]+|{_ESC}[01]|[^A-Za-z]"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESC), F.lit(_ESC + "0")), F.lit(_MARK), F.lit(_ESC + "1"))


def _unescaped(marked: Column) -> Column:
    bare = F.replace(marked, F.lit(_MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(_ESC + "1"), F.lit(_MARK)), F.lit(_ESC + "0"), F.lit(_ESC))


def _after(text: Column, sign: str) -> Column:
    """What follows the first sign; the text holds it."""
    return F.substring(text, F.length(F.substring_index(text, sign, 1)) + len(sign) + 1, F.length(text))


def restored(output: Column, form: Column) -> Column:
    """The text that fill_middle() made `output` of."""
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    first, rest = F.substring_index(body, SUFFIX, 1), _after(body, SUFFIX)
    psm = F.concat(first, _after(rest, MIDDLE), F.substring_index(rest, MIDDLE, 1))
    first, rest = F.substring_index(body, PREFIX, 1), _after(body, PREFIX)
    spm = F.concat(F.substring_index(rest, MIDDLE, 1), _after(rest, MIDDLE), first)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """One row per input row: doc_id, n, form (plain, psm, spm), prefix, middle, suffix, output, restored.

    A text of n units (a run of ASCII letters, or any other code point) is cut
    behind two of them, or before the first. Both places, and whether `rate` per
    cent of the texts are cut and `spm_rate` per cent of those get the suffix first,
    follow from the SHA-256 of seed and id, so a row comes out the same wherever it
    is worked on. A text that is empty or holds one of the signs stays plain; its
    prefix, middle and suffix are null, and its output is the text.

    Everything is a column expression over one row, so nothing is shuffled and a
    long text takes time in proportion to its length: the marker is escaped, put
    behind each unit, and counted, parts are read off up to the k-th marker, and
    what was escaped comes back. `restored` is rebuilt from output and form alone.

    A null text is empty; a null id draws as an empty one does. Rows of one id draw
    alike. An empty table gives an empty result; other columns are not read.
    """
    rows = fill_partitions(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("draw", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = rows.withColumn("draw", draw).withColumn("marked", F.regexp_replace(_escaped(F.col("text")), _UNIT, "$0" + _MARK))
    rows = rows.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(_MARK), F.lit("")))).cast("long"))
    one, two = F.pmod(h[0], F.col("n") + 1), F.pmod(h[1], F.col("n") + 1)
    signs = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | signs | (F.pmod(h[2], F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(h[3], F.lit(100)) < spm_rate, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", "marked", form.alias("form"), F.least(one, two).cast("int").alias("a"), F.greatest(one, two).cast("int").alias("b"))
    cut = F.col("form") != "plain"
    # The marked text ends with a marker: what is right of the (n - b + 1)-th from the right are the units behind the b-th.
    upto = F.expr(f"substring_index(marked, '{_MARK}', b)")
    parts = {
        "prefix": F.expr(f"substring_index(marked, '{_MARK}', a)"),
        "middle": F.when(F.col("a") > 0, F.substring(upto, F.length(F.expr(f"substring_index(marked, '{_MARK}', a)")) + 1, F.length(upto))).otherwise(upto),
        "suffix": F.expr(f"substring_index(marked, '{_MARK}', cast(b - n - 1 as int))"),
    }
    rows = rows.select("doc_id", "text", "n", "form", *(F.when(cut, _unescaped(x)).alias(name) for name, x in parts.items()))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    rows = rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))
    return rows.withColumn("restored", restored(F.col("output"), F.col("form")))
