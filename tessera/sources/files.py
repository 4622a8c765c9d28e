"""Sources and sinks: lead lists, logs, feeds, and the outputs made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import normalize_domain

#: Header names of the columns of a lead list, fixed words.
ALIASES = {
    "domain": ("domain", "website", "url", "company domain", "company website", "company_domain", "website url"),
    "company": ("company name", "company", "name", "company_name", "account name", "organization"),
    "employees": ("employee size", "employees", "employee count", "employee_count", "headcount", "size", "company size"),
}


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every row of a lead list: row_no as in a spreadsheet (the header is row 1), domain, company, employees and input, a
    map of all cells as they are. Cells stay text. Rows are numbered by their place in the file, so a list is one file."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    names = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}

    def role(r: str) -> Column:
        found = next((names[a] for a in ALIASES[r] if a in names), None)
        return F.coalesce(F.trim(F.col(f"`{found}`")), F.lit("")) if found else F.lit("")

    cells = [x for c in raw.columns for x in (F.lit(c.lstrip("﻿").strip()), F.coalesce(F.col(f"`{c}`"), F.lit("")))]
    out = raw.select(normalize_domain(role("domain")).alias("domain"), role("company").alias("company"), role("employees").alias("employees"), F.create_map(*cells).alias("input"))
    # Spark's ids hold the partition above 33 bits and the row's place in it below; what comes before a partition is added.
    at, place = F.monotonically_increasing_id(), F.shiftrightunsigned("_at", 33)
    ordered = out.withColumn("_at", at)
    sizes = sorted((r.part, r.n) for r in ordered.groupBy(place.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    before, offsets = 2, []
    for part, n in sizes:
        offsets += [F.lit(part).cast("long"), F.lit(before).cast("long")]
        before += n
    offset = F.element_at(F.create_map(*offsets), place) if offsets else F.lit(2)
    return ordered.withColumn("row_no", (offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")).drop("_at").select("row_no", "domain", "company", "employees", "input")


def work_list(rows: DataFrame) -> DataFrame:
    """The first row of each good domain."""
    first = F.min("row_no").over(Window.partitionBy("domain"))
    return rows.where(F.col("domain").isNotNull()).withColumn("_first", first).where("row_no = _first").drop("_first")


def list_report(rows: DataFrame) -> DataFrame:
    """How many rows a list has, how many are bad or repeat a domain."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("domain").isNull()).alias("bad"), (F.count("domain") - F.count_distinct("domain")).alias("repeats"))


def final_list(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Every row with the findings of its domain; repeats point to their first row, bad domains are a NO."""
    first = F.min("row_no").over(Window.partitionBy("domain"))
    marked = rows.withColumn("first_row", F.when(F.col("domain").isNotNull(), first))
    note = F.when(F.col("domain").isNull(), "bad domain").when(F.col("first_row") < F.col("row_no"), F.concat(F.lit("Duplicate of row "), F.col("first_row").cast("string"))).otherwise("")
    joined = marked.withColumn("note", note).join(findings, "domain", "left")
    return joined.withColumn("icp", F.when(F.col("domain").isNull(), "NO").otherwise(F.col("icp"))).drop("first_row")


def read_log(spark: SparkSession, path: str, schema: str, month: str | None = None, at: str = "time") -> DataFrame:
    """JSON lines, malformed ones left out; month keeps times that start with it."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col(at).startswith(month)) if month else rows


def unescaped(text: Column) -> Column:
    """The usual character references of HTML as characters."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("#x27", "'"), ("apos", "'"), ("nbsp", " "), ("ndash", "–"), ("mdash", "—"), ("rsquo", "’"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def plain_text(text: Column) -> Column:
    """Text without tags, references as characters, white space as one space."""
    bare = unescaped(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "))
    return F.trim(F.regexp_replace(bare, r"[\s\x{A0}]+", " "))


_NAMED, _YES = "struct<name:string>", ("1", "True", "true")
_both = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), ", ")
_names = lambda c: F.array_join(F.filter(F.transform(c, lambda x: x["name"]), lambda x: x.isNotNull() & (x != "")), ", ")
_says = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains("remote")
#: Shapes of job feeds by board. The schema of the answer, where its jobs are, and of each job the title, place,
#: whether it says remote, description and address. account is the board account's name (workday: tenant.wd/site).
FEEDS = {
    "greenhouse": ("json", f"jobs array<struct<title:string,location:{_NAMED},content:string,absolute_url:string>>", "jobs", lambda j, acc: (j["title"], j["location"]["name"], F.lit(False), j["content"], j["absolute_url"])),
    "lever": (
        "json", "array<struct<text:string,categories:struct<location:string>,descriptionPlain:string,lists:array<struct<content:string>>,additionalPlain:string,workplaceType:string,hostedUrl:string>>", None,
        lambda j, acc: (j["text"], j["categories"]["location"], j["workplaceType"] == "remote", F.concat_ws(" ", j["descriptionPlain"], F.array_join(F.transform(F.coalesce(j["lists"], F.array().cast("array<struct<content:string>>")), lambda x: x["content"]), " "), j["additionalPlain"]), j["hostedUrl"]),
    ),
    "ashby": ("json", "jobs array<struct<title:string,location:string,isRemote:boolean,descriptionPlain:string,descriptionHtml:string,jobUrl:string>>", "jobs", lambda j, acc: (j["title"], j["location"], j["isRemote"], F.coalesce(F.nullif(j["descriptionPlain"], F.lit("")), j["descriptionHtml"]), j["jobUrl"])),
    "workable": ("json", "jobs array<struct<title:string,city:string,country:string,telecommuting:boolean,description:string,url:string>>", "jobs", lambda j, acc: (j["title"], _both(j["city"], j["country"]), j["telecommuting"], j["description"], j["url"])),
    "rippling": ("json", f"items array<struct<name:string,locations:array<{_NAMED}>,url:string>>", "items", lambda j, acc: (j["name"], _names(j["locations"]), F.lit(False), F.lit(""), j["url"])),
    "workday": ("json", "jobPostings array<struct<title:string,locationsText:string,remoteType:string,externalPath:string>>", "jobPostings", lambda j, acc: (j["title"], j["locationsText"], _says(j["remoteType"]), F.lit(""), F.concat(F.lit("https://"), F.replace(acc, F.lit("/"), F.lit(".myworkdayjobs.com/")), F.coalesce(j["externalPath"], F.lit(""))))),
    "bamboohr": ("json", "result array<struct<id:string,jobOpeningName:string,location:struct<city:string,state:string>,isRemote:string,locationType:string>>", "result", lambda j, acc: (j["jobOpeningName"], _both(j["location"]["city"], j["location"]["state"]), j["isRemote"].isin(*_YES) | (j["locationType"] == "1"), F.lit(""), F.concat(F.lit("https://"), acc, F.lit(".bamboohr.com/careers/"), j["id"]))),
    "dover": ("json", "results array<struct<title:string,locations:array<struct<name:string,location_type:string>>>>", "results", lambda j, acc: (j["title"], F.array_join(F.transform(j["locations"], lambda x: F.coalesce(x["name"], x["location_type"])), ", "), F.lit(False), F.lit(""), F.lit(""))),
    "smartrecruiters": ("json", "content array<struct<name:string,location:struct<city:string,country:string,remote:boolean>>>", "content", lambda j, acc: (j["name"], _both(j["location"]["city"], j["location"]["country"]), j["location"]["remote"], F.lit(""), F.lit(""))),
    "recruitee": ("json", "offers array<struct<title:string,location:string,remote:boolean,description:string,careers_url:string>>", "offers", lambda j, acc: (j["title"], j["location"], j["remote"], j["description"], j["careers_url"])),
    "breezy": ("json", "array<struct<name:string,location:struct<name:string,is_remote:boolean>,url:string>>", None, lambda j, acc: (j["name"], j["location"]["name"], j["location"]["is_remote"], F.lit(""), j["url"])),
    "teamtailor": ("xml", "channel struct<item:array<struct<title:string,description:string,link:string,`tt:remoteStatus`:string,`tt:locations`:struct<`tt:location`:array<struct<`tt:name`:string>>>>>>", "channel.item", lambda j, acc: (j["title"], F.array_join(F.transform(j["tt:locations"]["tt:location"], lambda x: x["tt:name"]), ", "), _says(j["tt:remoteStatus"]), j["description"], j["link"])),
    "personio": ("xml", "position array<struct<name:string,office:string,jobDescriptions:struct<jobDescription:array<struct<value:string>>>>>", "position", lambda j, acc: (j["name"], j["office"], F.lit(False), F.array_join(F.transform(j["jobDescriptions"]["jobDescription"], lambda x: x["value"]), " "), F.lit(""))),
}


def _jobs_in(shape: str) -> Column:
    kind, schema, inside, _ = FEEDS[shape]
    body = F.from_json("body", schema) if kind == "json" else F.from_xml("body", schema)
    for name in (inside or "").split(".") if inside else ():
        body = body[name]
    return body


def parse_feeds(feeds: DataFrame, most: int = 200) -> DataFrame:
    """(domain, job_no, title, location, remote, description, url) from (domain, shape, account, body): the first jobs of each
    feed that have a title. shape is a board's name.

    A body that isn't such a feed gives no row; an empty feed neither, but feed_counts tells the two apart.
    """
    def job_by(fields):
        def job(j: Column) -> Column:
            title, place, remote, text, url = fields(j, F.col("account"))
            place = F.coalesce(place, F.lit(""))
            remote = F.coalesce(remote, F.lit(False)) | _says(place)
            return F.struct(F.trim(F.coalesce(title, F.lit(""))).alias("title"), place.alias("location"), remote.alias("remote"), F.substring(plain_text(text), 1, 4000).alias("description"), F.coalesce(url, F.lit("")).alias("url"))

        return job

    parts = []
    for shape, (_, _, _, fields) in FEEDS.items():
        titled = F.slice(F.filter(F.transform(_jobs_in(shape), job_by(fields)), lambda j: j["title"] != ""), 1, most)
        parts.append(feeds.where(F.col("shape") == shape).select("domain", F.posexplode(titled).alias("job_no", "j")).select("domain", "job_no", "j.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feed_counts(feeds: DataFrame) -> DataFrame:
    """Jobs in each feed: null where the body isn't one, 0 where it is empty."""
    n = None
    for shape in FEEDS:
        jobs = _jobs_in(shape)
        size = F.when(jobs.isNotNull(), F.size(jobs))
        n = F.when(F.col("shape") == shape, size) if n is None else n.when(F.col("shape") == shape, size)
    return feeds.select("domain", "shape", n.alias("jobs"))


def sitemap_urls(maps: DataFrame) -> DataFrame:
    """(domain, url) of each <loc> of (domain, body)."""
    return maps.select("domain", F.explode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))


def write_wide(df: DataFrame, path: str, order: str = "row_no") -> None:
    """A CSV in the list's own order. Spark sorts by ranges and writes a file for each, so no task holds it all."""
    df.orderBy(order).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_log(df: DataFrame, path: str) -> None:
    """Appends JSON lines."""
    df.write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], created: str) -> DataFrame:
    """Both tables' rows, the newest of each key."""
    rest = [c for c in old.columns if c not in keys]
    both = old.unionByName(new, allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), created).alias("r")).select(*keys, "r.*")


def without_expired(df: DataFrame, created: str, as_of: str, days: int) -> DataFrame:
    """Rows young enough on a day."""
    return df.where(F.col(created) >= F.date_sub(F.lit(as_of).cast("date"), days))
