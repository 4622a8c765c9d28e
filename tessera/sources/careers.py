"""Jobs read off a company's own careers page, and where its jobs are looked up: boards first, then that page.

A page's jobs come from the first source that has any: job postings of its structured data, links to pages of single jobs
whose text reads like a title, headings that end like one. Everything is worked out in the page's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import page_rules as P
from tessera.operators.structured import BLOCK, whole_json
from tessera.sources.files import plain_text

#: Words of job titles, endings of headings that are titles, paths of single jobs, texts that are no job, and
#: words on a job's card beside its title.
ROLE = (
    r"(?i)\b(engineer|developer|designer|manager|director|head|lead|analyst|scientist|specialist|associate|"
    r"coordinator|representative|executive|officer|consultant|architect|administrator|accountant|"
    r"controller|bookkeeper|recruiter|intern|researcher|technician|writer|editor|strategist|"
    r"marketer|operator|advisor|partner|founding|vp|chief|cfo|cto|coo|sales|support|success|"
    r"marketing|operations|finance|product|account|legal|counsel|nurse|physician|teacher)\b"
)
TITLE_END = (
    r"(?i)(?:engineer|developer|designer|manager|director|analyst|scientist|specialist|associate|"
    r"coordinator|representative|executive|officer|consultant|architect|administrator|accountant|"
    r"controller|bookkeeper|recruiter|intern|researcher|technician|writer|editor|strategist|"
    r"\bhead of [a-z &]+|\bvp,? [a-z &]+|\blead)(?:\s*\([^)]*\))?(?:\s*[-–,|].{0,40})?$"
)
JOB_PATH = r"(?i)/(?:careers?|jobs?|positions?|openings?|roles?|join-us|work-with-us|vacancies)/[^/?#]{3,}"
NOT_A_JOB = (
    r"(?i)\b(?:all jobs|view all|see all|open positions|open roles|careers?|apply now|learn more|"
    r"read more|join us|our team|benefits|culture|life at|faq|privacy|blog)\b"
)
CARD_NOISE = (
    r"(?i)\s*\b(?:view role|view job|apply now|apply|learn more|full[- ]time|part[- ]time|contract|"
    r"internship|in[- ]person|on[- ]?site|remote|hybrid)\b"
)
ANCHOR = r"""(?is)<a\b[^>]*\bhref=["']([^"'#]+)["'][^>]*>(.*?)</a>"""
HEADING = r"(?is)<(h[2-5])\b[^>]*>(.*?)</\1>"
#: Jobs of a page, and boards of a company, that are looked at.
MOST_JOBS, MOST_BOARDS = 100, 3


def host_of(url: Column) -> Column:
    """A URL's host in lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def joined(base: Column, link: Column) -> Column:
    """A page's link as a full URL: absolute, from the scheme, the root or the page's folder, or a query; dots in paths stay."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(F.length(page) > F.length(origin), F.regexp_extract(page, r"^(.*/)", 1)).otherwise(F.concat(origin, F.lit("/")))
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), link))
        .when(link.startswith("/"), F.concat(origin, link)).when(link.startswith("?"), F.concat(page, link)).otherwise(F.concat(folder, link))
    )


def job(title: Column, location: Column, remote: Column, description: Column, url: Column) -> Column:
    place = F.coalesce(location, F.lit(""))
    return F.struct(
        F.trim(F.coalesce(title, F.lit(""))).alias("title"), place.alias("location"), (F.coalesce(remote, F.lit(False)) | F.lower(place).contains("remote")).alias("remote"),
        F.substring(plain_text(description), 1, 4000).alias("description"), F.coalesce(url, F.lit("")).alias("url"),
    )


def n_words(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def firsts(items: Column, key) -> Column:
    """Items whose key none before them has."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def posted(html: Column) -> Column:
    """Jobs of job postings at the top of structured data: of a list, of a graph, or one alone."""
    values = F.transform(F.regexp_extract_all(html, F.lit(BLOCK), F.lit(1)), whole_json)
    said = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    items = F.flatten(F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.coalesce(said(v, "$", "array<variant>"), said(v, "$['@graph']", "array<variant>"), F.array(v))))
    # A type may be a text or a list of texts.
    found = F.filter(items, lambda v: F.coalesce(said(v, "$['@type']"), F.array_join(said(v, "$['@type']", "array<string>"), " "), F.lit("")).contains("JobPosting"))
    place = lambda v: F.array_join(F.filter(F.array(said(v, "$.jobLocation.address.addressLocality"), said(v, "$.jobLocation.address.addressRegion")), lambda x: x != ""), ", ")
    return F.transform(found, lambda v: job(said(v, "$.title"), place(v), said(v, "$.jobLocationType") == "TELECOMMUTE", said(v, "$.description"), said(v, "$.url")))


def linked(html: Column, url: Column) -> Column:
    """Jobs of links to pages of single jobs of the company's own host; each page once."""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("inner"))
    links = F.transform(both, lambda x: F.struct(joined(url, x.href).alias("full"), plain_text(x.inner).alias("text")))
    own = host_of(url)

    def reads_like_one(x: Column) -> Column:
        host = host_of(x.full)
        same = (host == own) | host.endswith(F.concat(F.lit("."), own))
        return same & path_of(x.full).rlike(JOB_PATH) & n_words(x.text).between(2, 10) & ~x.text.rlike(NOT_A_JOB) & x.text.rlike(ROLE)

    def card(x: Column) -> Column:
        title = F.trim(F.regexp_replace(F.regexp_replace(x.text, CARD_NOISE, " "), r"\s+", " "))
        there = F.when(x.text.rlike(r"(?i)\bin[- ]person\b|\bon[- ]?site\b"), "in person").otherwise("")
        return job(title, there, x.text.rlike(r"(?i)\bremote\b"), F.lit(""), x.full)

    return F.transform(firsts(F.filter(links, reads_like_one), lambda x: x.full), card)


def headed(html: Column, url: Column) -> Column:
    """Jobs of headings that end like a title; each text once."""
    texts = F.transform(F.regexp_extract_all(html, F.lit(HEADING), F.lit(2)), plain_text)
    titles = F.array_distinct(F.filter(texts, lambda t: n_words(t).between(2, 8) & t.rlike(TITLE_END) & ~t.rlike(NOT_A_JOB)))
    return F.transform(titles, lambda t: job(t, F.lit(""), F.lit(False), F.lit(""), url))


def page_jobs(pages: DataFrame) -> DataFrame:
    """(domain, job_no, title, location, remote, description, url, source) of careers pages (domain, url, html)."""
    html = F.coalesce("html", F.lit(""))
    every = F.array(*[F.struct(F.lit(name).alias("source"), jobs.alias("jobs")) for name, jobs in (("posting", posted(html)), ("link", linked(html, F.col("url"))), ("heading", headed(html, F.col("url"))))])
    first = F.get(F.filter(every, lambda s: F.size(s.jobs) > 0), F.lit(0))
    rows = pages.select("domain", first.alias("s")).where("s is not null")
    return rows.select("domain", "s.source", F.posexplode(F.slice("s.jobs", 1, MOST_JOBS)).alias("job_no", "j")).select("domain", "job_no", "j.*", "source")


def looked_up(board_jobs: DataFrame, boards: DataFrame, careers: DataFrame) -> DataFrame:
    """Jobs of each company: those of the first of its MOST_BOARDS first boards that has any, else those of its careers page.

    board_jobs (domain, shape, job_no, title, location, remote, description, url), boards (domain, board) that its pages link to
    in the order of BOARDS, careers as page_jobs gives it. source is the board's name or the page's source.
    """
    order = F.element_at(F.create_map(*[F.lit(x) for k, (board, _) in enumerate(P.BOARDS) for x in (board, k)]), F.col("board"))
    asked = boards.groupBy("domain").agg(F.slice(F.array_sort(F.collect_set(F.struct(order.alias("k"), "board"))), 1, MOST_BOARDS).alias("asked"))
    asked = asked.select("domain", F.explode("asked").alias("a")).select("domain", F.col("a.k").alias("k"), F.col("a.board").alias("shape"))
    found = board_jobs.join(asked, ["domain", "shape"])
    best = found.groupBy("domain").agg(F.min("k").alias("k"))
    fields = ("domain", "job_no", "title", "location", "remote", "description", "url", "source")
    from_boards = found.join(best, ["domain", "k"]).withColumn("source", F.col("shape")).select(*fields)
    return from_boards.unionByName(careers.join(best.select("domain"), "domain", "left_anti").select(*fields))
