"""Awkward tables for every operator."""

SF = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; as extra columns they must do no harm.
CLASH = ("id", "h", "epoch", "domain", "tokens", "slot", "key", "band", "a", "b", "score", "rank", "language", "block", "kind", "n", "__gone_id", "__domain", "__pd", "part", "row")


def docs(spark, rows):
    full = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOC)


def awkward(spark, clash=True):
    from pyspark.sql import functions as F

    long = "palabra del mundo entero " * 20_000
    rows = [
        (1, "the cat sat on the mat and looked at the dog in the garden", "en", "src1"),
        (1, "the cat sat on the mat and looked at the dog in the garden", "en", "src1"),
        (2, None, "en", "src1"), (3, "", "de", None), (4, "der Hund und die Katze sind in dem Garten", None, "src2"),
        (None, "le chat est dans le jardin avec le chien", "fr", "src3"), (5, long, "es", "src1"), (6, "?!.. 12345 ---", "en", ""),
        (7, "zz \x00 \x01 \U0001f600 ▁ end", "en", "src2"), (8, "   \n\t ", "en", "src2"), (9, "ok", "", "src1"),
    ]
    df = docs(spark, rows)
    return df.withColumns({c: F.lit(f"x-{c}") for c in CLASH}) if clash else df


def nothing(spark):
    return docs(spark, [])


def table(spark, name, sf_dir=SF):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
