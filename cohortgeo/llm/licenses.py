"""10. License scans by canonical digests.

A text is brought to a canonical form: lower case; copyright lines dropped; every run of anything but a-z and 0-9 one space; equivalent
spellings made one. SHA-256 of the whole canonical text is joined with the digests of the known licence texts, which are brought to
their form by the same expressions, and with stated digests of long ones (Apache, GPL, LGPL, GFDL, MPL, CC0, Artistic). SQL functions only.

Defined cases: null counts as empty; an empty canonical text is no licence. Of two licences with one digest the name first in order stands.
Texts of any length are read whole. Repeated rows stay rows. An empty table gives no row. Kept columns called digest or license raise
ValueError; others make no difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortgeo.llm.license_texts import DIGESTS, KNOWN

#: A line that names a holder: from its start, after marks, to its end.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[ \t]+(\(c\)|©|[0-9<\[{])|c\)|©|all rights reserved)[^\n]*"
#: Equivalent spellings, canonical last.
SPELLINGS = (
    ("licence", "license"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("utilis", "utiliz"),
    ("initialis", "initializ"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("merchantib", "merchantab"),
    ("non infringement", "noninfringement"),
    ("sub license", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("https ", "http "),
    ("whilst", "while"),
)


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    return out


def scan(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep`, the canonical text's digest and the licence, null if it isn't known."""
    if clash := {"digest", "license"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are made here and can't be kept as well")
    spark = docs.sparkSession
    known = spark.createDataFrame(list(KNOWN), "license string, __text string").select(F.sha2(canonical(F.col("__text")), 256).alias("digest"), "license")
    known = known.unionByName(spark.createDataFrame([(d, n) for n, d in DIGESTS], "digest string, license string"))
    known = known.groupBy("digest").agg(F.min("license").alias("license"))  # two texts of one form are one entry
    marked = docs.select(*[F.col(f"`{c}`") for c in keep], F.sha2(canonical(F.col(text_col)), 256).alias("digest"))
    return marked.join(F.broadcast(known), "digest", "left").select(*[F.col(f"`{c}`") for c in keep], "digest", "license")  # a fixed table


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])


def _sql(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(lower(coalesce({text}, '')), {quote(COPYRIGHT_LINE)}, '', 'g')"
    out = f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"
    for other, one in SPELLINGS:
        out = f"replace({out}, {quote(other)}, {quote(one)})"
    return out


def oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)
    long = ", ".join(f"('{n}', '{d}')" for n, d in DIGESTS)
    return f"""
with known as (select digest, min(l) license from (select sha256({_sql("t")}) digest, l from (values {rows}) k(l, t) union all select d, l from (values {long}) k(l, d)) group by 1),
     marked as (select doc_id, sha256({_sql("text")}) digest from documents)
select m.doc_id, m.digest, k.license from marked m left join known k on m.digest = k.digest"""
