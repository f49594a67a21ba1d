"""Layout normalization of whole texts against a plain version, e-mail addresses and URLs included."""

import re
import unicodedata

from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.plans import catalog

SF = "/root/testdata/sf0.01"
S = r"[ \t\n\x0b\f\r]"


def plain(text):
    if text is None:
        return None
    v = re.sub("\r\n?", "\n", unicodedata.normalize("NFC", text)).translate({ord(c): "-" for c in T.BULLETS})
    v = re.sub(r"([A-Za-z0-9._%+-]+)\s*@\s*([A-Za-z0-9-]+(?:\s*\.\s*[A-Za-z0-9-]+)+)", lambda m: f"{m[1]}@{re.sub(r'\s+', '', m[2])}", v)
    v = re.sub(rf"(?i)\bhttps{S}*:{S}*/{S}*/{S}*", "https://", v)
    v = re.sub(rf"(?i)\bhttp{S}*:{S}*/{S}*/{S}*", "http://", v)
    v = re.sub(rf"(?i)\bwww{S}*\.{S}*", "www.", v)
    v = re.sub(rf"(?<=[A-Za-z0-9]){S}*\.{S}*(?=[A-Za-z]{{2,}}(?:\b|/))", ".", v)
    v = "\n".join(re.sub(r"[ \t\x0b\f\r]+", " ", x).strip(T.SPACES) for x in re.sub("[\r\x0b\x0c\x1c-\x1e\x85  ]", "\n", v).split("\n"))
    return re.sub("\n{3,}", "\n\n", v).strip(T.SPACES)


def test_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(-1, "write to  jo . e @ mail . example . org\nor www . example . com"), (-2, "https : / / a.b/c  \n\n\n\n• x"), (-3, None)]
    texts = {**{r.doc_id: r.text for r in docs.collect()}, **dict(odd)}
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r.doc_id: r.n for r in rows.select("doc_id", T.normalized(F.col("text")).alias("n")).collect()}
    assert sum(bool(t and re.search("@|://|www", t)) for t in texts.values()) > 5
    assert got == {k: plain(t) for k, t in texts.items()}


def test_query_keeps_every_document(spark):
    rows = catalog.QUERIES["text_normalize"](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
