"""The document library: slugs and dates, chunks and their search, labels, listings and run accounts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SIZE, OVERLAP = 1000, 150


# ---- names ----------------------------------------------------------------------------------------


def _slug(text: Column, sep: str, fallback: str, length: int) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", sep), f"^{sep}+|{sep}+$", "")
    return F.substring(F.when(slug == "", fallback).otherwise(slug), 1, length)


def paper_slug(source: Column, source_id: Column) -> Column:
    return _slug(F.concat_ws("_", source, source_id), "_", "unknown", 64)


def pdf_filename(source: Column, source_id: Column) -> Column:
    return F.concat(_slug(F.concat_ws("_", source, source_id), "_", "unknown", 80), F.lit(".pdf"))


def slug_from_filename(name: Column) -> Column:
    """The last part of a path without its extension; a name that is all extension keeps its point."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)/*$", 1), r"(?<=[^.])\.[^.]*$", "")
    return _slug(stem, "-", "untitled", 80)


def stable_hash(*parts: Column) -> Column:
    """16 hexadecimal digits of SHA-1 over the parts, each closed by a zero byte."""
    zero = F.unhex(F.lit("00"))
    return F.substring(F.sha1(F.concat(*[x for p in parts for x in (F.encode(p.cast("string"), "UTF-8"), zero)])), 1, 16)


# ---- dates ----------------------------------------------------------------------------------------


def parse_time(text: Column) -> Column:
    """ISO or RFC 2822 text to a UTC timestamp; null for what is neither. The session's time zone must be UTC."""
    s = F.trim(text)
    mail = F.regexp_extract(s, r"^(?:[A-Za-z]{3}, *)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(?::\d{2})?)", 1)
    full = F.when(F.length(mail) - F.length(F.regexp_replace(mail, ":", "")) == 1, F.concat(mail, F.lit(":00"))).otherwise(mail)
    local = F.try_to_timestamp(full, F.lit("d MMM yyyy HH:mm:ss"))
    zone = F.regexp_extract(s, r"([+-]\d{4})\s*(?:\(.*\))?$", 1)
    shift = F.when(zone == "", 0).otherwise(F.concat(F.substring(zone, 1, 1), F.lit("1")).cast("int") * (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")))
    rfc = F.timestamp_micros(F.unix_micros(local) - shift.cast("long") * 60_000_000)
    return F.when(s == "", None).when(F.instr(s, ",") > 0, F.when(mail != "", rfc)).otherwise(F.try_to_timestamp(s))


def knowledge_time(published: Column, updated: Column) -> Column:
    """The later of both dates; unknown without the first."""
    return F.when(parse_time(published).isNotNull(), F.greatest(parse_time(published), parse_time(updated)))


def visible(known: Column, decision: Column, lag_days: int = 1) -> Column:
    return F.coalesce(F.to_date(known) <= F.date_sub(F.to_date(decision), lag_days), F.lit(False))


def add_business_days(day: Column, n: int) -> Column:
    """The n-th business day after a day (n > 0)."""
    dow = F.weekday(day)  # Monday is 0
    start, left = F.date_sub(day, F.greatest(dow - 4, F.lit(0))), F.lit(n) + F.least(dow, F.lit(4))
    return F.date_add(F.date_sub(start, F.least(dow, F.lit(4))), (F.floor(left / 5) * 7 + left % 5).cast("int"))


def contaminated(day: Column, cutoff: str, buffer_days: int) -> Column:
    """Whether a day lies before the first one that is clear of a cutoff and a buffer of business days."""
    return day < add_business_days(F.to_date(F.lit(cutoff)), buffer_days + 1)


# ---- chunks and search ----------------------------------------------------------------------------


def _stop(text: str, start: int, size: int, overlap: int) -> int:
    """Where the window from `start` ends: at the last space among its last `overlap` characters, or when it is full."""
    full = start + size
    if full >= len(text):
        return len(text)
    space = text[full - overlap : full].rfind(" ")
    return full if space < 0 else full - overlap + space


def cut(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Windows of at most `size` characters of a text with single spaces; each begins `overlap` before the last one's end."""
    text, spans, at = " ".join((text or "").split()), [], 0
    while at < len(text):
        spans.append((at, _stop(text, at, size, overlap)))
        at = len(text) if spans[-1][1] == len(text) else max(spans[-1][1] - overlap, at + 1)
    return [piece for a, z in spans if (piece := text[a:z].strip())]


def chunks(docs: DataFrame, keys: list[str], text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """keys, idx, chunk: the windows of each text, in order. A cut depends on the one before, which SQL cannot say."""

    @F.pandas_udf("array<string>")
    def windows(s: pd.Series) -> pd.Series:
        return s.map(lambda t: cut(t, size, overlap))

    return docs.select(*keys, F.posexplode(windows(text)).alias("idx", "chunk"))


def tokens(text: Column) -> Column:
    """Lower-cased words of letters (with hyphens inside) and single CJK characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z\-]+|[\x{4e00}-\x{9fff}]"), F.lit(0))


def query_terms(query: str) -> list[str]:
    """Words of a free query: everything but letters, digits and underscores parts them."""
    return list(dict.fromkeys(re.sub(r"[^\w\s]", " ", query.lower()).split()))


def bm25(docs: DataFrame, text: str, terms: list[str], k1: float = 1.5, b: float = 0.75, words=None, out: str = "score") -> DataFrame:
    """Rows with any of the terms, and their score. A row's words are counted in the row: nothing is shuffled but one row
    of counts, which is sent to all tasks."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return docs.withColumn(out, F.lit(0.0)).where(F.lit(False))
    own = (words or (lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\w+"), F.lit(0))))(F.col(text))
    count = lambda t: F.size(F.filter("_w", lambda w: w == t))
    held = docs.withColumn("_w", own).withColumns({"_len": F.size("_w")} | {f"_f{k}": count(t) for k, t in enumerate(terms)}).drop("_w")
    stats = held.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_f{k}") > 0).alias(f"_d{k}") for k in range(len(terms))])
    score = sum(F.log(1 + (F.col("_n") - F.col(f"_d{k}") + 0.5) / (F.col(f"_d{k}") + 0.5)) * F.col(f"_f{k}") * (k1 + 1) / (F.col(f"_f{k}") + k1 * (1 - b + b * F.col("_len") / F.greatest("_avg", F.lit(1e-9)))) for k in range(len(terms)))
    any_ = sum(F.col(f"_f{k}") for k in range(len(terms))) > 0
    return held.where(any_).crossJoin(F.broadcast(stats)).withColumn(out, score).select(*docs.columns, out)


def search_chunks(pieces: DataFrame, papers: DataFrame, keys: list[str], query: str, limit: int = 10, kind: str | None = None) -> DataFrame:
    """The best chunks for a query with their papers' columns; lower is better, as in full-text tables. With a kind, only
    papers of that kind are searched, so that `limit` rows come back where there are as many."""
    scored = bm25(pieces, "chunk", query_terms(query), k1=1.2)
    if kind is not None:
        papers = papers.where(F.col("kind") == kind)
    return scored.join(papers, keys).withColumn("score", F.round(-F.col("score"), 3)).orderBy("score", *keys, "idx").limit(limit)


def get_chunks(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_chunks, fulltext: a paper's chunks in order, joined by an empty line."""
    held = F.array_sort(F.collect_list(F.struct("idx", "chunk")))
    return pieces.groupBy(*keys).agg(held.alias("_c")).select(*keys, F.size("_c").alias("n_chunks"), F.array_join(F.transform("_c", lambda x: x["chunk"]), "\n\n").alias("fulltext"))


def paper_context(pieces: DataFrame, keys: list[str], paper: dict, query: str | None = None, max_chunks: int = 6) -> DataFrame:
    """One paper: indexed?, and its best chunks for a query (scored against all chunks) or else its full text."""
    of = [F.col(k) == F.lit(v) for k, v in paper.items()]
    if query:
        scored = bm25(pieces, "chunk", query_terms(query), k1=1.2)
        for c in of:
            scored = scored.where(c)
        return scored.orderBy(F.desc("score"), "idx").limit(max_chunks)
    mine = pieces
    for c in of:
        mine = mine.where(c)
    one = mine.agg(F.array_sort(F.collect_list(F.struct("idx", "chunk"))).alias("_c"))
    return one.select((F.size("_c") > 0).alias("indexed"), F.size("_c").alias("n_chunks"), F.array_join(F.transform("_c", lambda x: x["chunk"]), "\n\n").alias("fulltext"))


def list_indexed(pieces: DataFrame, papers: DataFrame, keys: list[str]) -> DataFrame:
    """Papers with chunks, how many, and the papers' columns (null where the paper is unknown)."""
    return pieces.groupBy(*keys).agg(F.count("*").alias("n_chunks")).join(papers, keys, "left")


def ingest_summary(targets: DataFrame, pieces: DataFrame, keys: list[str], has_file: str, failed: str) -> DataFrame:
    """One row: targets, already indexed (skipped), without a file, failed, newly indexed, chunks."""
    known = pieces.groupBy(*keys).agg(F.count("*").alias("_n"))
    all_ = targets.join(known, keys, "left")
    done, file, bad = F.col("_n").isNotNull(), F.coalesce(F.col(has_file), F.lit(False)), F.coalesce(F.col(failed), F.lit(False))
    return all_.agg(F.count("*").alias("targets"), F.count_if(done).alias("skipped"), F.count_if(~done & ~file).alias("no_file"), F.count_if(~done & file & bad).alias("failed"), F.count_if(~done & file & ~bad).alias("indexed"), F.coalesce(F.sum("_n"), F.lit(0)).alias("chunks"))


# ---- texts with JSON, reasoning or wrong encodings --------------------------------------------------


def _balanced(text: str, at: int) -> Iterator[str]:
    """The span from an opening brace to the brace that closes it, if one does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            yield text[at : m.end()]
            return


def first_object(text: str | None) -> str | None:
    """The first JSON object in a reply, as JSON; code fences and prose around it do not matter."""
    text = re.sub(r"```(?:json)?", "", text or "", flags=re.I)
    for m in re.finditer(r"\{", text):
        for part in _balanced(text, m.start()):
            try:
                value = json.loads(part)
            except ValueError:
                continue
            if isinstance(value, dict):
                return json.dumps(value, ensure_ascii=False, sort_keys=True)
    return None


def first_json(text: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(first_object)

    return run(text)


def think_split(text: Column) -> Column:
    """(content, reasoning): what stands in think marks, or before a lone closing mark, is reasoning."""
    whole = r"(?s)<think>(.*?)</think>"
    inline = F.regexp_extract_all(text, F.lit(whole), F.lit(1))
    lone = (F.size(inline) == 0) & text.contains("</think>")
    head, tail = F.substring_index(text, "</think>", 1), F.expr("1")
    tail = F.substring(text, F.length(head) + F.length(F.lit("</think>")) + 1, F.length(text))
    content = F.when(F.size(inline) > 0, F.regexp_replace(text, whole, "")).when(lone, tail).otherwise(text)
    reasoning = F.when(F.size(inline) > 0, F.array_join(inline, "\n")).when(lone, F.replace(head, F.lit("<think>"), F.lit(""))).otherwise(F.lit(""))
    blank = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.struct(blank(content).alias("content"), blank(reasoning).alias("reasoning"))


def decision(text: Column) -> Column:
    """(direction, confidence) of a reply's JSON object; null unless the direction is long, short or flat and the
    confidence lies within 0 and 1."""
    got = F.from_json(first_json(text), T.StructType([T.StructField("direction", T.StringType()), T.StructField("confidence", T.DoubleType())]))
    ok = got["direction"].isin("long", "short", "flat") & got["confidence"].between(0, 1)
    return F.when(ok, got)


# The shape of UTF-8 read as Latin-1, and what must not be left after a repair.
MOJIBAKE = "[Â-ô][\u0080-¿]"
RESIDUE = "[\u0080-\u009f]|â€|[Â-ô][\u0080-¿]"


def repaired(text: str | None) -> str | None:
    """The text read as UTF-8 again, once or twice; null if it does not look wrong or does not come out clean."""
    if not text or not re.search(MOJIBAKE, text):
        return None
    out = text
    for _ in range(2):
        for codec in ("latin-1", "cp1252"):
            try:
                out = out.encode(codec).decode("utf-8")
                break
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        if not re.search(RESIDUE, out):
            return out if out != text else None
    return None


def repair_mojibake(text: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(repaired)

    return run(text)


# ---- labels, listings, accounts ---------------------------------------------------------------------


def effective(papers: DataFrame, labels: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Papers with kind (a label's own, or else by rule), its sub-categories and then the label's further ones.

    labels: keys, kind (strategy, factor or null), subcats (list or null).
    """
    from . import classify

    own = labels.select(*keys, F.col("kind").alias("_kind"), F.col("subcats").alias("_more"))
    auto = classify.kind(papers, text).withColumnRenamed("kind", "auto_kind").drop("subcats").join(own, keys, "left")
    out = auto.withColumn("kind", F.coalesce("_kind", "auto_kind"))
    return out.withColumn("subcats", F.array_union(classify.subcategories(text, F.col("kind")), F.coalesce("_more", F.array().cast("array<string>")))).drop("_kind", "_more")


def list_papers(papers: DataFrame, day: str | None = None, pdf: str | None = None, kind: str | None = None, subcat: str | None = None) -> DataFrame:
    """Papers by file ("local" or "any"), kind and sub-category; the day counts only if no other filter is given."""
    if pdf == "local":
        papers = papers.where("pdf_local is not null and pdf_local <> ''")
    elif pdf == "any":
        papers = papers.where("pdf_url is not null and pdf_url <> ''")
    if kind:
        papers = papers.where(F.col("kind") == kind)
    if subcat:
        papers = papers.where(F.array_contains("subcats", subcat))
    if day and not (pdf or kind or subcat):
        papers = papers.where(F.substring(F.col("fetched_at").cast("string"), 1, 10) == day)
    return papers


def labelled(labels: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Labels after changes (keys, seq, action, value): add or remove a sub-category, or set the kind; an unknown kind
    is refused. Tags are trimmed and lower-cased, each held once in the order of its (last) addition."""
    tag = F.lower(F.trim("value"))
    bad = (F.col("action") == "kind") & F.col("value").isNotNull() & ~F.col("value").isin("strategy", "factor")
    checked = changes.withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit("unknown kind "), F.col("value")))).otherwise(F.when(F.col("action") == "kind", F.col("value")).otherwise(tag)))
    old = labels.select(*keys, F.posexplode_outer("subcats").alias("seq", "value")).where("value is not null").select(*keys, (F.col("seq") - 1_000_000).cast("long").alias("seq"), F.lit("add").alias("action"), "value")
    tags = old.unionByName(checked.where("action <> 'kind' and value <> ''").select(*keys, F.col("seq").cast("long").alias("seq"), "action", "value"))
    last = tags.groupBy(*keys, "value").agg(F.max_by("action", "seq").alias("a"), F.max(F.when(F.col("action") == "remove", F.col("seq"))).alias("gone"), F.collect_list(F.struct("seq", "action")).alias("all"))
    since = F.array_min(F.transform(F.filter("all", lambda x: (x["action"] == "add") & (F.col("gone").isNull() | (x["seq"] > F.col("gone")))), lambda x: x["seq"]))
    kept = last.where("a = 'add'").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(since.alias("s"), "value"))), lambda x: x["value"]).alias("subcats"))
    kinds = checked.where("action = 'kind'").groupBy(*keys).agg(F.max_by("value", "seq").alias("new"), F.lit(True).alias("set"))
    every = labels.select(*keys, "kind").join(changes.select(*keys).distinct(), keys, "full_outer").join(kinds, keys, "left").join(kept, keys, "left")
    return every.select(*keys, F.when(F.col("set"), F.col("new")).otherwise(F.col("kind")).alias("kind"), F.coalesce("subcats", F.array().cast("array<string>")).alias("subcats"))


def run_accounts(events: DataFrame, run: str = "run_id", ts: str = "ts") -> DataFrame:
    """A row for each run from its start and finish rows: started, finished, error (the last), ok."""
    out = events.groupBy(run).agg(F.min(F.when(F.col("event") == "start", F.col(ts))).alias("started"), F.max(F.when(F.col("event") == "finish", F.col(ts))).alias("finished"), F.max_by("error", F.when(F.col("event") == "finish", F.col(ts))).alias("error"))
    return out.withColumn("ok", F.col("error").isNull() & F.col("finished").isNotNull())


def new_or_latest(papers: DataFrame, day: str, limit: int = 50, asked: bool = False) -> DataFrame:
    """Papers fetched on a day; if none were and the day was not asked for, the latest ones."""
    today = papers.where(F.substring(F.col("fetched_at").cast("string"), 1, 10) == day)
    latest = papers.orderBy(F.desc_nulls_last("published"), F.desc("fetched_at")).limit(limit)
    return today if asked or not today.isEmpty() else latest


def appended(ledger: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """A ledger with the new rows whose key it does not hold; of new rows with one key the first by `order`."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
    return ledger.unionByName(first.join(ledger.select(key), key, "left_anti"))


def merged(fresh: Column, existing: Column, user_keys: tuple[str, ...]) -> Column:
    """A map of fresh values in which those that a user may edit are kept as they exist."""
    return F.map_concat(F.map_filter(fresh, lambda k, v: ~(k.isin(*user_keys) & F.map_contains_key(existing, k))), F.map_filter(existing, lambda k, v: k.isin(*user_keys)))
