"""Collection algebra: which addresses to fetch, which documents to keep, which targets to take.

The fetching itself is a table of responses; everything here is joins and
windows over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import lexicons as lx
from tessella.functions import text as tx
from tessella.functions import urls
from tessella.operators.labels import SEED, uniform

RENDER_GAIN = 2000


def discovered_links(pages: DataFrame) -> DataFrame:
    """``(doc_id, url, role)`` of every link ``pages(doc_id, url, links)`` that looks like a document of interest, in page order.

    A link may have several roles.  Anchors, mail and script links are left out.
    """
    hay = lambda x: F.concat_ws(" ", x["text"], x["href"])
    x = pages.select("doc_id", F.col("url").alias("base"), F.posexplode("links").alias("pos", "link"))
    x = x.where(~F.lower(F.coalesce("link.href", F.lit(""))).rlike(r"^(?:javascript:|mailto:|#|$)"))
    x = x.withColumn("hay", hay(F.col("link")))
    hit = F.array_compact(F.array(*[F.when(F.col("hay").rlike(p), F.struct(F.lit(r).alias("role"), F.lit(i).alias("rank"))) for i, (r, p) in enumerate(lx.LINK_ROLES)]))
    x = x.select("doc_id", "pos", urls.absolute(F.col("link.href"), F.col("base")).alias("url"), F.explode(hit).alias("r"))
    return x.select("doc_id", "url", "r.role", "pos")


def policy_rank(url: Column) -> Column:
    """Sort key of a policy's address: without cookie, without settings, with privacy, short paths first."""
    u = F.lower(url)
    return F.struct(
        u.contains("cookie").cast("int").alias("a"), u.rlike("settings|preference|choices").cast("int").alias("b"), (~u.contains("privacy")).cast("int").alias("c"),
        F.length(urls.path(url)).alias("d"), url.alias("e"),
    )


def best_policy_url(candidates: DataFrame, by: str = "target_id") -> DataFrame:
    """One address per target by ``policy_rank``."""
    return candidates.groupBy(by).agg(F.min_by("url", policy_rank(F.col("url"))).alias("url"))


def extract_policy_url(links: Column, base: Column, own_hosts: tuple[str, ...]) -> Column:
    """First link that mentions privacy and doesn't lead to the store itself."""
    good = F.filter(
        F.transform(links, lambda x: F.struct(F.lower(F.concat_ws(" ", x["text"], x["href"])).alias("hay"), urls.absolute(x["href"], base).alias("url"))),
        lambda x: x["hay"].contains("privacy") & ~urls.host(x["url"]).isin(*own_hosts) & x["url"].rlike("(?i)^https?://"),
    )
    return F.get(good, F.lit(0))["url"]


def lookup_result(json: Column) -> Column:
    """First result of a store's lookup response."""
    r = F.from_json(json, "struct<results:array<struct<trackName:string,sellerUrl:string,trackViewUrl:string,bundleId:string,trackId:bigint>>>")["results"]
    return F.get(r, F.lit(0))


def lookup_url(app_id: Column, endpoint: str) -> Column:
    """Address that looks an app up: by bundle id if there is a point in it, else by number."""
    return F.when(app_id.contains("."), F.concat(F.lit(endpoint + "?bundleId="), app_id)).otherwise(F.concat(F.lit(endpoint + "?id="), app_id))


def first_per_content(docs: DataFrame, text: str = "text", order: str = "ord", key: str | None = None) -> DataFrame:
    """Documents whose visible text no earlier document of the target has; ``key`` names a column that holds the texts' keys already."""
    k = docs.withColumn("_k", F.col(key) if key else tx.sha1_of_trimmed(F.coalesce(F.col(text), F.lit(""))))
    w = Window.partitionBy("target_id", "_k").orderBy(order, "doc_id")
    return k.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_k", "_r")


def latest_deliveries(docs: DataFrame) -> DataFrame:
    """One row per document: the one delivered last; equal rows collapse."""
    w = Window.partitionBy("doc_id").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("fetched_at").desc_nulls_last(), "url")
    return docs.where("doc_id IS NOT NULL").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def registry_paths(targets: DataFrame) -> DataFrame:
    """``(target_id, role, path)``: registries tried by convention for each kind of target."""
    rows = lambda k: F.array(*[F.struct(F.lit(r).alias("role"), F.lit(p).alias("path")) for r, p in lx.REGISTRY_PATHS[k]])
    paths = F.when(F.col("target_type").isin(*lx.APP_TYPES), rows("app")).otherwise(rows("web"))
    return targets.select("target_id", F.inline(paths))


def root_urls(targets: DataFrame, docs: DataFrame) -> DataFrame:
    """``(target_id, root)``: origin of the first of seed policy, own address, policy documents and any documents that isn't a store's."""
    t = targets.select("target_id", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("seed_policy_url").alias("url")), F.struct(F.lit(1).alias("rank"), F.col("url").alias("url")))).alias("c"))
    d = docs.select("target_id", F.struct(F.when(F.col("role") == "privacy_policy", 2).otherwise(3).alias("rank"), F.col("url").alias("url")).alias("c"))
    c = t.unionByName(d).select("target_id", "c.rank", "c.url", urls.host(F.col("c.url")).alias("h")).where((F.col("h") != "") & ~F.col("h").isin(*lx.STORE_HOSTS))
    return c.groupBy("target_id").agg(F.min_by(urls.origin(F.col("url")), F.struct("rank", "url")).alias("root"))


def policy_hosts(docs: DataFrame) -> DataFrame:
    """``(target_id, host)`` of each target's first policy."""
    return docs.where("role = 'privacy_policy'").groupBy("target_id").agg(F.min_by(urls.host(F.col("url")), "doc_id").alias("host"))


def registry_candidates(targets: DataFrame, docs: DataFrame) -> DataFrame:
    """Registry addresses to probe: conventional paths at the root, for roles that a target lacks."""
    want = registry_paths(targets).join(docs.select("target_id", "role").distinct(), ["target_id", "role"], "left_anti")
    return want.join(root_urls(targets, docs), "target_id").select("target_id", "role", F.concat("root", "path").alias("url"))


def companion_candidates(targets: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """Companion pages to probe for web targets: links found in saved pages, then conventional paths.

    Only roles that a target lacks and addresses that it hasn't; the first
    role of an address counts.
    """
    web = targets.where(F.col("target_type").isin(*lx.WEB_TYPES)).select("target_id").distinct()
    found = links.where(F.col("role").isin(*lx.BACKFILL_ROLES)).select("target_id", "role", "url", F.lit(0).alias("rank"))
    paths = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(p).alias("path")) for r, p in lx.COMPANION_PATHS])
    tried = root_urls(targets, docs).select("target_id", "root", F.inline(paths)).select("target_id", "role", F.concat("root", "path").alias("url"), F.lit(1).alias("rank"))
    c = found.unionByName(tried).join(web, "target_id", "left_semi")
    c = c.join(docs.select("target_id", "role").distinct(), ["target_id", "role"], "left_anti").join(docs.select("target_id", "url").distinct(), ["target_id", "url"], "left_anti")
    order = F.struct("rank", F.array_position(F.array(*map(F.lit, lx.BACKFILL_ROLES)), F.col("role")).alias("p"))
    return c.groupBy("target_id", "url").agg(F.min_by("role", order).alias("role"), F.min("rank").alias("rank"))


def usable_targets(classified: DataFrame, docs: DataFrame) -> DataFrame:
    """Targets with a well-fetched document of a recognised medium."""
    good = docs.where("ok").select("doc_id")
    return classified.where("medium IS NOT NULL").join(good, "doc_id", "left_semi").select("target_id").distinct()


def stratified_sample(targets: DataFrame, usable: DataFrame, per_type: int, oversample: int = 3, seed: int = SEED) -> DataFrame:
    """Usable targets up to ``per_type`` of each type, from the first ``per_type`` x ``oversample`` of a seeded order."""
    w = Window.partitionBy("target_type").orderBy(uniform(F.col("target_id"), seed), "target_id")
    t = targets.select("target_id", "target_type").distinct().withColumn("tried", F.row_number().over(w)).where(F.col("tried") <= per_type * oversample)
    t = t.join(usable.select("target_id").distinct().withColumn("u", F.lit(1)), "target_id", "left")
    run = F.sum(F.coalesce("u", F.lit(0))).over(Window.partitionBy("target_type").orderBy("tried"))
    return t.withColumn("_n", run).where(F.col("u").isNotNull() & (F.col("_n") <= per_type)).select("target_type", "target_id", "tried")


def rendered(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of re-rendered bodies: a new one replaces the old if it is longer by 2,000 characters or more."""
    n = new.select("doc_id", F.col("raw").alias("_new"))
    gain = F.length("_new") >= F.length(F.coalesce("raw", F.lit(""))) + RENDER_GAIN
    return old.join(n, "doc_id", "left").withColumn("raw", F.when(F.coalesce(gain, F.lit(False)) & F.col("role").isin(*lx.SCRIPTED_ROLES), F.col("_new")).otherwise(F.col("raw"))).drop("_new")


def starting_points(targets: DataFrame) -> DataFrame:
    """``(target_id, role, url)`` at which the collection of each target begins.

    Websites and data brokers: the seed policy and the home page; apps: the
    seed policy and the store's page of the app.
    """
    store = (
        F.when(F.col("target_type") == "play_store_app", F.concat(F.lit("https://play.google.com/store/apps/details?id="), F.col("app_id")))
        .when(F.col("target_type") == "app_store_app", F.concat(F.lit("https://apps.apple.com/app/id"), F.col("app_id")))
    )
    pages = F.array(
        F.struct(F.lit("privacy_policy").alias("role"), F.col("seed_policy_url").alias("url")),
        F.struct(F.when(F.col("target_type").isin(*lx.APP_TYPES), "store_listing").otherwise("home").alias("role"), F.coalesce(store, F.col("url")).alias("url")),
    )
    return targets.select("target_id", F.inline(pages)).where("url <> ''").distinct()


def collect_targets(targets: DataFrame, responses: DataFrame) -> DataFrame:
    """Documents of targets, as a crawl over a table of responses would find them.

    ``responses(url, status, links)`` stands for the network.  From the
    starting points, links that look like documents of interest on the same
    site are followed one step, and registries are tried at the root of each
    target.  One row per target and address: ``(target_id, url, role,
    http_status, error)``, the role that led there first; an address without a
    response has status 0 and an error.
    """
    start = starting_points(targets)
    r = responses.groupBy("url").agg(F.min("status").alias("status"), F.first("links", ignorenulls=True).alias("links"))
    pages = start.join(r.where("status = 200"), "url").select(F.struct("target_id", "url").alias("doc_id"), "url", "links")
    links = discovered_links(pages).select("doc_id.target_id", "doc_id.url", "role", F.col("url").alias("to")).where(urls.same_site(F.col("to"), F.col("url")))
    followed = links.select("target_id", "role", F.col("to").alias("url"))
    none = F.lit(None).cast("string")
    registries = registry_candidates(targets, start.select("target_id", F.lit("").alias("role"), none.alias("url")))
    wanted = start.withColumn("rank", F.lit(0)).unionByName(followed.withColumn("rank", F.lit(1))).unionByName(registries.withColumn("rank", F.lit(2)))
    order = F.struct("rank", "role")
    one = wanted.groupBy("target_id", "url").agg(F.min_by("role", order).alias("role"))
    return one.join(r.select("url", "status"), "url", "left").select(
        "target_id", "url", "role", F.coalesce("status", F.lit(0)).alias("http_status"), F.when(F.col("status").isNull(), "no response").when(F.col("status") == 200, "").otherwise(F.concat(F.lit("status "), "status")).alias("error")
    )


def collection_report(docs: DataFrame) -> DataFrame:
    """One row of counts: targets, documents, registries and companions by role."""
    return docs.agg(
        F.count_distinct("target_id").alias("targets"), F.count("*").alias("docs"), F.count_if("ok").alias("ok_docs"),
        F.count_if(F.col("role").isin(*lx.REGISTRY_ROLES)).alias("registries"), *[F.count_if(F.col("role") == r).alias(r) for r in lx.BACKFILL_ROLES],
    )
