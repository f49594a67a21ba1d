"""Skills, job titles and places by alias tables, which are parameters; skills come as a table of any size."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import strip

#: A small skill table for tests and demonstrations; production tables come from a file (skills_from_json).
SKILLS = {
    "Python": ("python", "python3"), "SQL": ("sql",), "PostgreSQL": ("postgresql", "postgres"), "Docker": ("docker",), "Kubernetes": ("kubernetes", "k8s"),
    "AWS": ("aws", "amazon web services"), "Spark": ("spark", "apache spark"), "PySpark": ("pyspark",), "Kafka": ("kafka",), "Java": ("java",),
    "JavaScript": ("javascript", "js"), "React": ("react", "reactjs", "react.js"), "C++": ("c++", "cpp"), "C": ("c",), "R": ("r",), "Go": ("go", "golang"),
    "Machine Learning": ("machine learning", "ml"), "Computer Vision": ("computer vision", "cv"), "Git": ("git",), "Airflow": ("airflow",),
}
#: Spellings up to this number go to every executor; more are joined by shuffles, and never are the texts sent to the driver.
SMALL = 200_000
#: Spellings up to this number stand in the plan itself.
IN_PLAN = 2_000
#: Names that are words of every text: they count only inside a skills section.
SHORT_SKILLS = ("C", "R", "Go")
#: Canonical job titles and their aliases, in order of precedence. Fixed values.
JOB_TITLES = {
    "Backend Developer": ("backend developer", "backend engineer", "lập trình viên backend", "phát triển backend", "be dev", "backend dev"),
    "Frontend Developer": ("frontend developer", "frontend engineer", "lập trình viên frontend", "phát triển frontend", "fe dev", "frontend dev"),
    "Fullstack Developer": ("fullstack developer", "fullstack engineer", "lập trình viên fullstack", "full stack", "fullstack dev"),
    "Mobile Developer": ("mobile developer", "mobile engineer", "lập trình viên di động", "android developer", "ios developer", "flutter developer", "react native developer"),
    "DevOps Engineer": ("devops engineer", "devops", "sre", "site reliability engineer", "kỹ sư devops"),
    "Data Engineer": ("data engineer", "kỹ sư dữ liệu"),
    "Data Scientist": ("data scientist", "nhà khoa học dữ liệu"),
    "Data Analyst": ("data analyst", "chuyên viên phân tích dữ liệu"),
    "AI/ML Engineer": ("ai engineer", "ml engineer", "machine learning engineer", "kỹ sư ai", "kỹ sư trí tuệ nhân tạo"),
    "QA/QC Engineer": ("qa engineer", "qc engineer", "tester", "kiểm thử phần mềm", "automation tester", "manual tester"),
    "System Administrator": ("system administrator", "sysadmin", "quản trị hệ thống"),
    "Security Engineer": ("security engineer", "cybersecurity", "chuyên viên an toàn thông tin"),
    "UI/UX Designer": ("ui/ux designer", "ui designer", "ux designer", "thiết kế giao diện"),
    "Product Manager": ("product manager", "quản lý sản phẩm"),
    "Project Manager": ("project manager", "quản lý dự án"),
    "Scrum Master": ("scrum master",),
    "Business Analyst": ("business analyst", "phân tích nghiệp vụ"),
    "Embedded Engineer": ("embedded engineer", "kỹ sư nhúng"),
    "Cloud Engineer": ("cloud engineer", "cloud architect"),
    "Solution Architect": ("solution architect", "kiến trúc sư giải pháp"),
    "Software Engineer": ("software engineer", "lập trình viên", "kỹ sư phần mềm", "developer"),
}
#: Provinces and the spellings that stand for them. Fixed values.
PROVINCES = {
    "Hà Nội": ("Hà Nội", "Ha Noi", "HaNoi", "HN"),
    "Hồ Chí Minh": ("Hồ Chí Minh", "Ho Chi Minh", "HoChiMinh", "TP.HCM", "TPHCM", "Sài Gòn", "Sai Gon", "HCM"),
    "Đà Nẵng": ("Đà Nẵng", "Da Nang", "DaNang"),
    "Cần Thơ": ("Cần Thơ", "Can Tho"),
    "Hải Phòng": ("Hải Phòng", "Hai Phong", "HaiPhong"),
    "An Giang": ("An Giang", "AnGiang"),
    "Bà Rịa - Vũng Tàu": ("Bà Rịa - Vũng Tàu", "Ba Ria - Vung Tau", "BaRiaVungTau", "Vũng Tàu"),
    "Bắc Giang": ("Bắc Giang", "Bac Giang", "BacGiang"),
    "Bắc Ninh": ("Bắc Ninh", "Bac Ninh", "BacNinh"),
    "Bình Dương": ("Bình Dương", "Binh Duong", "BinhDuong"),
    "Bình Định": ("Bình Định", "Binh Dinh", "BinhDinh"),
    "Bình Phước": ("Bình Phước", "Binh Phuoc"),
    "Bình Thuận": ("Bình Thuận", "Binh Thuan"),
    "Đồng Nai": ("Đồng Nai", "Dong Nai", "DongNai"),
    "Gia Lai": ("Gia Lai", "GiaLai"),
    "Hải Dương": ("Hải Dương", "Hai Duong"),
    "Khánh Hòa": ("Khánh Hòa", "Khanh Hoa", "KhanhHoa", "Nha Trang"),
    "Lâm Đồng": ("Lâm Đồng", "Lam Dong", "Đà Lạt", "Da Lat"),
    "Long An": ("Long An", "LongAn"),
    "Nghệ An": ("Nghệ An", "Nghe An", "Vinh"),
    "Quảng Nam": ("Quảng Nam", "Quang Nam"),
    "Quảng Ninh": ("Quảng Ninh", "Quang Ninh", "Hạ Long"),
    "Thái Nguyên": ("Thái Nguyên", "Thai Nguyen"),
    "Thanh Hóa": ("Thanh Hóa", "Thanh Hoa"),
    "Thừa Thiên Huế": ("Thừa Thiên Huế", "Thua Thien Hue", "Huế", "Hue"),
    "Vĩnh Phúc": ("Vĩnh Phúc", "Vinh Phuc"),
}


def skills_from_json(path: str) -> dict[str, tuple[str, ...]]:
    """{"skills": {name: [alias, ...]}} of a file on the driver."""
    with open(path, encoding="utf-8") as f:
        return {str(k): tuple(map(str, v)) for k, v in json.load(f)["skills"].items()}


def skill_table(spark: SparkSession, skills: dict | None = None) -> DataFrame:
    """(alias, canonical, words, key): one row per spelling in lower case, the canonical name's own included; `key` is the
    spelling as the words of a text are taken."""
    rows = {}
    for name, aliases in (skills or SKILLS).items():
        for a in (*aliases, name):
            key = [w for w in (x.strip(".") for x in re.split(r"[^\w+#.]+", a.lower())) if w]
            rows.setdefault(a.lower(), (a.lower(), name, len(key), " ".join(key)))
    return spark.createDataFrame(list(rows.values()), "alias string, canonical string, words int, key string")


def canonical_skills(names: DataFrame, table: DataFrame, *, name: str = "name") -> DataFrame:
    """`names` with canonical: the skill of which the name is a spelling, else the name itself, trimmed."""
    keyed = names.withColumn("_k", F.lower(strip(F.col(name)))).join(table.select(F.col("alias").alias("_k"), F.col("canonical").alias("_c")), "_k", "left")
    return keyed.withColumn("canonical", F.coalesce("_c", strip(F.col(name)))).drop("_k", "_c")


def alias_hits(rows: DataFrame, table: DataFrame, keep: tuple[str, ...], *, edge: str = "+#", text: str = "text") -> DataFrame:
    """(*keep, alias, canonical, places): spellings that stand in `text` between characters other than letters, digits, _ and `edge`.

    Runs of words of the text, as long as the table's spellings are, meet these in an equi-join; a run that meets one is
    kept if the spelling stands there letter by letter. Spellings are broadcast if they are few, so that a common word does not
    gather in one task, and very few sort out within the row which runs go on. A run may give several rows, whose places add up.
    """
    counted = {r["words"]: r["count"] for r in table.groupBy("words").count().collect()}  # as many as spellings have lengths
    sizes, total = sorted(n for n in counted if n), sum(counted.values())
    w = F.filter(F.split(F.lower(F.col(text)), r"(?U)[^\w+#.]+"), lambda x: x != "")
    bare = F.filter(F.transform(w, lambda x: F.btrim(x, F.lit("."))), lambda x: x != "")
    rows = rows.select(*keep, F.lower(F.col(text)).alias("_t"), bare.alias("_w"))
    keys = {r["key"] for r in table.select("key").distinct().collect()} if total <= IN_PLAN else None

    def runs(n: int) -> Column:
        if n == 1:
            return F.col("_w")
        whole = lambda i: F.array_join(F.slice("_w", i, n), " ")
        if keys is None:
            return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("_w"), F.lit(1))), lambda i: i + (n - 1) <= F.size("_w")), whole)
        first = {k.split(" ")[0] for k in keys if k.count(" ") == n - 1}
        return F.transform("_w", lambda x, i: F.when(x.isin(*first) & (i + n <= F.size("_w")), whole(i + 1)))

    # outer: Spark puts a filter on what is exploded before the split, which then made all words again for each of them
    grams = F.concat(*map(runs, sizes)) if sizes else F.array().cast("array<string>")
    if keys is None:
        rows = rows.select(*keep, "_t", F.explode_outer(grams).alias("key"), F.lit(1).alias("places"))
    else:
        rows = rows.select(*keep, "_t", F.filter(grams, lambda x: x.isin(*keys)).alias("_h"))
        each = F.transform(F.array_distinct("_h"), lambda k: F.struct(k.alias("key"), F.size(F.filter("_h", lambda x: x == k)).alias("places")))
        rows = rows.select(*keep, "_t", F.inline_outer(each))
    quoted = F.regexp_replace("alias", r"([^\p{L}\p{N}\s_])", r"\\$1")
    held = table.select("key", "alias", "canonical", F.concat(F.lit(rf"(?U)(?<![\w{edge}])"), quoted, F.lit(rf"(?![\w{edge}])")).alias("_p"))
    rows = rows.where("key IS NOT NULL").join(F.broadcast(held) if total <= SMALL else held.hint("merge"), "key")
    return rows.where(F.regexp_like("_t", F.col("_p"))).select(*keep, "alias", "canonical", "places")


def skill_mentions(docs: DataFrame, table: DataFrame, *, doc: str = "doc_id", text: str = "text", strict: bool = False) -> DataFrame:
    """(doc_id, canonical, mentions): skills spelled out in the texts; see alias_hits. `doc` may be any column that groups rows.

    `strict`: not next to dots either, and without the names in SHORT_SKILLS, which are words of running text as well.
    """
    rows = alias_hits(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), table, ("doc_id",), edge="+#." if strict else "+#")
    if strict:
        rows = rows.where(~F.col("canonical").isin(*SHORT_SKILLS))
    return rows.groupBy("doc_id", "canonical").agg(F.sum("places").alias("mentions"))


def _bounded(alias: str) -> str:
    return r"(?iU)(?<!\w)" + re.sub(r"([^\w\s])", r"\\\1", alias.lower()) + r"(?!\w)"


def job_titles(text: Column) -> Column:
    """Canonical titles, in order of precedence, of which an alias stands in `text`."""
    return F.array_compact(F.array(*(F.when(F.regexp_like(F.lower(text), F.lit("|".join(map(_bounded, a)))), F.lit(k)) for k, a in JOB_TITLES.items())))


def profile_titles(headline: Column, titles: Column, roles: Column) -> Column:
    """Canonical titles of a headline, of job titles and of project roles; the different ones as they are, if none is known."""
    told = F.filter(F.concat(F.array(headline), titles, roles), lambda t: F.coalesce(strip(t), F.lit("")) != "")
    known = job_titles(F.array_join(told, " "))
    bare = F.transform(told, lambda t: strip(t))
    low = F.transform(bare, lambda t: F.lower(t))
    return F.when(F.size(known) > 0, known).otherwise(F.filter(bare, lambda t, i: F.array_position(low, F.lower(t)) == i + 1))


def place_of(address: Column, places: Column) -> Column:
    """The province of an address, else of the first of `places` that there is; null without either."""
    first = F.get(F.filter(places, lambda p: F.coalesce(strip(p), F.lit("")) != ""), F.lit(0))
    return F.coalesce(province(address), province(first))


def province(text: Column) -> Column:
    """The province whose longest spelling stands in `text`; else the text itself, trimmed."""
    spelled = sorted(((v, k) for k, vs in PROVINCES.items() for v in vs), key=lambda x: -len(x[0]))
    found = [F.when(F.regexp_like(F.lower(text), F.lit(_bounded(v))), F.lit(k)) for v, k in spelled]
    return F.when(strip(text) != "", F.coalesce(*found, strip(text)))
