"""Queries of the search engine's operators over posts (table ingress), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plover.functions import text as X
from plover.operators import authors as A
from plover.operators import batch as B
from plover.operators import index as I
from plover.operators import posts as P
from plover.operators import rank as R
from plover.operators import search as S
from plover.plans import plan
from plover.plans.engine import Search, SearchEngine
from plover.plans.ir import Query
from plover.plans.ir import query_key as key_of
from plover.plans.parse import parse
from plover.queries.sqlparts import ANALYSED, AUTHORS, ENGAGEMENT, POSTINGS, POSTS, RECENCY, TOKENS, bucket, q
from plover.queries.store import NOW, analysed, kept, latest_authors, postings, posts, term_table
from plover.sources.tables import table

FROM = 1767225600000  # 2026-01-01
TERMS = ["security", "leaks", "changelog", "twice", "update", "hot"]
MUST = ["security", "leaks"]
SOFT = ["update"]
PHRASE = ["hot", "take"]
TYPO = "secuirty"
QUERIES_RAW = [
    "security leaks", '"hot take" -update', "update OR changelog", "pics of the roadmap last summer", "changelog since:2026-01-01 sort:latest",
    "cheap laptop", "cybertruck vs rivian", "apple tweets not about the iphone", "min_likes:10 has:image warranty", "from:nobody update",
]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lst(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def inn(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


# ---- text
@query(f"WITH {TOKENS} SELECT post_id, unnest(tokens) AS term, CAST(unnest(range(1, len(tokens) + 1)) AS INTEGER) AS pos FROM tok")
def tokenize_docs(spark, d):
    numbered = F.transform("tokens", lambda t, i: F.struct(t.alias("term"), (i + 1).alias("pos")))
    return X.exploded(X.tokenized(posts(spark, d)), numbered, "post_id", name="t").select("post_id", "t.term", "t.pos")


@query(f"WITH {TOKENS}, t AS (SELECT post_id, unnest(tokens) AS term FROM tok) SELECT post_id, term, count(*) AS tf FROM t GROUP BY ALL")
def term_frequency(spark, d):
    t = X.exploded(X.tokenized(posts(spark, d)), F.col("tokens"), "post_id")
    return t.groupBy("post_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query(f"WITH {ANALYSED}, t AS (SELECT DISTINCT post_id, unnest(pairs) AS pair FROM ana) SELECT replace(pair, chr(2), ' ') AS pair, count(*) AS df FROM t GROUP BY ALL")
def adjacent_bigrams(spark, d):
    t = X.exploded(X.tokenized(posts(spark, d)), F.array_distinct(X.adjacent_bigrams(F.col("tokens"))), name="pair")
    return t.groupBy(F.regexp_replace("pair", X.BIGRAM, " ").alias("pair")).agg(F.count(F.lit(1)).alias("df"))


@query(f"WITH {ANALYSED} SELECT post_id, unnest(aspects) AS aspect FROM ana")
def aspect_tags(spark, d):
    return X.exploded(X.tokenized(posts(spark, d)), X.aspect_tags(F.col("tokens"), F.col("text")), "post_id", name="aspect")


@query(f"WITH {TOKENS} SELECT post_id FROM tok WHERE len(list_filter(range(1, len(tokens_all)), lambda i: tokens_all[i] = 'hot' AND tokens_all[i + 1] = 'take')) > 0")
def phrase_match(spark, d):
    return X.tokenized(posts(spark, d)).filter(X.has_phrase(F.col("tokens_all"), PHRASE)).select("post_id")


@query(f"WITH {POSTS} SELECT post_id, regexp_matches(lower(text), {q(X.LINK)}) AS has_link, regexp_replace(lower(text), {q(X.LINK)}, ' ', 'g') AS cleaned FROM posts")
def url_strip(spark, d):
    return posts(spark, d).select("post_id", F.lower("text").alias("t")).select("post_id", F.col("t").rlike(X.LINK).alias("has_link"), F.regexp_replace("t", X.LINK, " ").alias("cleaned"))


@query("""WITH u AS (SELECT ingress_seq, unnest(media).url AS url FROM ingress)
SELECT ingress_seq, url, regexp_replace(url, '[?#].*$', '') AS public_url FROM u WHERE regexp_matches(url, '^https://[^/@?#]+([/?#]|$)')""")
def public_url(spark, d):
    u = table(spark, d, "ingress").select("ingress_seq", F.explode("media.url").alias("url"))
    return u.filter(F.col("url").rlike("^https://[^/@?#]+([/?#]|$)")).withColumn("public_url", F.regexp_replace("url", "[?#].*$", ""))


#: What each of ``QUERIES_RAW`` means, written by hand; its key is the FNV-1a hash of these characters.
MEANINGS = [
    '{"v":1,"intent":"topic","must":["leaks","security"],"should":[],"phrases":[],"exclude":[],"aspects":[],"filters":{"authorId":null,"since":null,"until":null,"media":null,"minLikes":null,"lang":null},"sort":"top"}',
    '{"v":1,"intent":"topic","must":[],"should":[],"phrases":[["hot","take"]],"exclude":["update"],"aspects":[],"filters":{"authorId":null,"since":null,"until":null,"media":null,"minLikes":null,"lang":null},"sort":"top"}',
    '{"v":1,"intent":"topic","must":[],"should":["changelog","update"],"phrases":[],"exclude":[],"aspects":[],"filters":{"authorId":null,"since":null,"until":null,"media":null,"minLikes":null,"lang":null},"sort":"top","union":true}',
    '{"v":1,"intent":"media","must":["roadmap"],"should":[],"phrases":[],"exclude":[],"aspects":[],"filters":{"authorId":null,"since":1748736000000,"until":1756684800000,"media":"image","minLikes":null,"lang":null},"sort":"top"}',
    '{"v":1,"intent":"topic","must":["changelog"],"should":[],"phrases":[],"exclude":[],"aspects":[],"filters":{"authorId":null,"since":1767225600000,"until":null,"media":null,"minLikes":null,"lang":null},"sort":"latest"}',
    '{"v":1,"intent":"topic","must":["laptop"],"should":["cheap"],"phrases":[],"exclude":[],"aspects":["~price"],"filters":{"authorId":null,"since":null,"until":null,"media":null,"minLikes":null,"lang":null},"sort":"top"}',
    '{"v":1,"intent":"compare","must":["cybertruck","rivian"],"should":[],"phrases":[],"exclude":[],"aspects":["~compare"],"filters":{"authorId":null,"since":null,"until":null,"media":null,"minLikes":null,"lang":null},"sort":"top"}',
    '{"v":1,"intent":"topic","must":["apple"],"should":[],"phrases":[],"exclude":["iphone"],"aspects":[],"filters":{"authorId":null,"since":null,"until":null,"media":null,"minLikes":null,"lang":null},"sort":"top"}',
    '{"v":1,"intent":"topic","must":["warranty"],"should":[],"phrases":[],"exclude":[],"aspects":[],"filters":{"authorId":null,"since":null,"until":null,"media":"image","minLikes":10,"lang":null},"sort":"top"}',
    '{"v":1,"intent":"topic","must":["update"],"should":[],"phrases":[],"exclude":[],"aspects":[],"filters":{"authorId":null,"since":null,"until":null,"media":null,"minLikes":null,"lang":null},"sort":"top"}',
]
_MEANT = ", ".join(f"({q(raw)}, {q(meaning)})" for raw, meaning in zip(QUERIES_RAW, MEANINGS, strict=True))


@query(f"""WITH m(raw, meaning) AS (VALUES {_MEANT}), h AS (SELECT raw, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(meaning, ''), lambda c: unicode(c)::HUGEINT)), lambda h, u: (xor(h, u) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM m)
SELECT raw, lower(printf('%08x', CAST(h // 4294967296 AS BIGINT)) || printf('%08x', CAST(h % 4294967296 AS BIGINT))) AS key FROM h""")
def query_key(spark, d):
    rows = [(raw, key_of(parse(raw, NOW))) for raw in QUERIES_RAW]
    return spark.createDataFrame(rows, "raw string, key string")


#: How each of ``QUERIES_RAW`` is read first, by hand: order of the reads, gates, unions and neighbouring pairs, before the data's
#: frequencies order the terms and drop unknown pairs.
_FIRST = [
    ("impact", ["security", "leaks"], [], ["security leaks"]),
    ("impact", ["hot", "take"], [], ["hot take"]),
    ("impact", [], ["update", "changelog"], []),
    ("time", ["roadmap"], [], []),
    ("time", ["changelog"], [], []),
    ("impact", ["laptop", "~price"], [], []),
    ("impact", ["cybertruck", "rivian", "~compare"], [], ["cybertruck rivian"]),
    ("impact", ["apple"], [], []),
    ("media", ["warranty"], [], []),
    ("impact", ["update"], [], []),
]
_READS = ", ".join(f"({q(raw)}, {q(read)}, {lst(gates)}::VARCHAR[], {lst(unions)}::VARCHAR[], {lst(pairs)}::VARCHAR[])" for raw, (read, gates, unions, pairs) in zip(QUERIES_RAW, _FIRST, strict=True))


@query(f"""WITH {POSTINGS}, m(raw, read, gates, unions, pairs) AS (VALUES {_READS}),
t AS (SELECT raw, 'g' AS part, unnest(gates) AS term FROM m UNION ALL SELECT raw, 'u', unnest(unions) FROM m UNION ALL SELECT raw, 'p', chr(2) || replace(unnest(pairs), ' ', chr(2)) FROM m),
o AS (SELECT raw, CASE part WHEN 'g' THEN 'g' ELSE 'u' END AS part, term, coalesce(df, 0) AS df FROM t LEFT JOIN dfs USING (term) WHERE part <> 'p' OR df > 0),
s AS (SELECT raw, part, array_to_string(list(term ORDER BY df, term), ' ') AS terms FROM o GROUP BY ALL)
SELECT m.raw, 'L0' AS level, read, coalesce(g.terms, '') AS gates, coalesce(u.terms, '') AS unions FROM m LEFT JOIN s g ON m.raw = g.raw AND g.part = 'g' LEFT JOIN s u ON m.raw = u.raw AND u.part = 'u'""")
def query_plans(spark, d):
    """The first plan of each query: level, read order, gates and unions, from the data's document frequencies."""
    parsed = {raw: parse(raw, NOW) for raw in QUERIES_RAW}
    words = sorted({t for x in parsed.values() for t in [*x.must, *x.should, *x.aspects, *plan.phrase_terms(x)]})
    pairs = [f"{X.BIGRAM}{a}{X.BIGRAM}{b}" for x in parsed.values() for of in (x.must, *x.phrases) for a, b in zip(of, of[1:], strict=False)]
    df = {r["term"]: r["df"] for r in term_table(spark, d).filter(F.col("term").isin([*words, *pairs])).collect()}
    rows = [(raw, p.level, p.read, " ".join(p.gates), " ".join(p.unions)) for raw, x in parsed.items() for p in [plan.first_plan(x, df)]]
    return spark.createDataFrame(rows, "raw string, level string, read string, gates string, unions string")


NEAR = plan.repair_neighbours(TYPO)


@query(f"WITH {POSTINGS} SELECT term AS neighbor, df FROM dfs WHERE term IN {inn(NEAR)}")
def repair_neighbors(spark, d):
    return term_table(spark, d).filter(F.col("term").isin(NEAR)).select(F.col("term").alias("neighbor"), "df")


@query(f"WITH {POSTINGS} SELECT {q(TYPO)} AS typed, arg_max(term, df * 1000000000 - (SELECT count(*) FROM dfs x WHERE x.term < dfs.term)) AS suggestion FROM dfs WHERE term IN {inn(NEAR)} HAVING count(*) > 0")
def did_you_mean(spark, d):
    known = term_table(spark, d).filter(F.col("term").isin(NEAR))
    return known.orderBy(F.desc("df"), "term").limit(1).select(F.lit(TYPO).alias("typed"), F.col("term").alias("suggestion"))


# ---- scores
@query(f"WITH {POSTS} SELECT post_id, round({ENGAGEMENT}, 6) AS value FROM posts")
def engagement_score(spark, d):
    return posts(spark, d).select("post_id", F.round(P.engagement(), 6).alias("value"))


@query(f"WITH {POSTS} SELECT post_id, round({ENGAGEMENT} + {RECENCY}, 6) AS value FROM posts")
def static_score(spark, d):
    return posts(spark, d).select("post_id", F.round(P.engagement() + P.static_recency(), 6).alias("value"))


@query(f"WITH {POSTS} SELECT post_id, {bucket(f'{ENGAGEMENT} + {RECENCY}')} AS value FROM posts")
def score_bucket(spark, d):
    return posts(spark, d).select("post_id", P.score_bucket(P.engagement() + P.static_recency()).alias("value"))


BOOSTED = f"""{POSTS}, edges AS (SELECT quoted_id AS t, {ENGAGEMENT} AS e FROM posts WHERE quoted_id IS NOT NULL UNION ALL SELECT retweet_of_id, {ENGAGEMENT} FROM posts WHERE retweet_of_id IS NOT NULL),
boosts AS (SELECT t AS post_id, sum(e) * 0.5 AS boost FROM edges GROUP BY t)"""


@query(f"WITH {BOOSTED} SELECT post_id, round(boost, 6) AS boost FROM boosts")
def boost_propagation(spark, d):
    return P.propagated_boosts(posts(spark, d)).withColumn("boost", F.round("boost", 6))


STATIC = f"{ENGAGEMENT} + coalesce(boost, 0) + {RECENCY}"


@query(f"WITH {BOOSTED} SELECT post_id, round({STATIC}, 6) AS static_score, {bucket(STATIC)} AS bucket FROM posts LEFT JOIN boosts USING (post_id)")
def refresh_scores(spark, d):
    return P.static_scores(posts(spark, d)).select("post_id", F.round("static_score", 6).alias("static_score"), "bucket")


# ---- filters
@query(f"WITH {POSTS} SELECT post_id FROM posts WHERE created_ms >= {FROM} AND created_ms < {NOW} AND media_type = 'image' AND likes >= 5 AND lang = 'en'")
def hard_filters(spark, d):
    keep = S.hard_filters({"since": FROM, "until": NOW, "media": "image", "minLikes": 5, "lang": "en"})
    return posts(spark, d).filter(keep).select("post_id")


@query(f"WITH {TOKENS} SELECT post_id FROM tok WHERE NOT list_has_any(tokens_all, {lst(SOFT + ['then'])})")
def exclude_terms(spark, d):
    return analysed(spark, d).filter(S.text_predicate(exclude=[*SOFT, "then"])).select("post_id")


@query(f"WITH {TOKENS} SELECT post_id FROM tok WHERE list_has_any(tokens_all, {lst(['update', 'changelog'])}) OR len(list_filter(range(1, len(tokens_all)), lambda i: tokens_all[i] = 'hot' AND tokens_all[i + 1] = 'take')) > 0")
def or_union(spark, d):
    return analysed(spark, d).filter(S.text_predicate(any_terms=["update", "changelog"], any_phrases=[PHRASE])).select("post_id")


@query(f"WITH {ANALYSED} SELECT post_id FROM ana WHERE list_contains(tokens, 'security') AND list_contains(tokens, 'leaks')")
def and_gates(spark, d):
    return analysed(spark, d).filter(S.text_predicate(gates=MUST)).select("post_id")


# ---- index
@query(f"WITH {POSTINGS} SELECT replace(term, chr(2), '+') AS term, post_id, tf FROM postings")
def build_postings(spark, d):
    t = I.terms_of_posts(I.analysed(posts(spark, d)))
    return t.select(F.regexp_replace("term", X.BIGRAM, "+").alias("term"), "post_id", "tf")


@query(f"WITH {POSTINGS} SELECT replace(term, chr(2), '+') AS term, df FROM dfs")
def term_df(spark, d):
    dfs = I.document_frequencies(I.terms_of_posts(I.analysed(posts(spark, d))))
    return dfs.select(F.regexp_replace("term", X.BIGRAM, "+").alias("term"), "df")


@query(f"WITH {TOKENS}, t AS (SELECT DISTINCT post_id, author_id, unnest(tokens) AS term FROM tok), a AS (SELECT author_id, term, count(*) AS delta FROM t GROUP BY ALL) SELECT term, CAST(greatest(sum(delta), 0) AS BIGINT) AS df FROM a GROUP BY term")
def df_fold(spark, d):
    """Deltas staged per author's batch, then folded into an empty dictionary."""
    words = X.exploded(X.tokenized(posts(spark, d)), F.array_distinct("tokens"), "author_id")
    staged = words.groupBy("author_id", "term").agg(F.count(F.lit(1)).alias("delta")).select(F.array(F.struct("term", "delta")).alias("deltas"))
    return I.fold_deltas(spark.createDataFrame([], "term string, df long"), staged)


@query(f"WITH {POSTINGS}, qt AS (SELECT unnest({lst([*TERMS, 'zzz'])}) AS term) SELECT term, coalesce(df, 0) AS df, CAST(row_number() OVER (ORDER BY coalesce(df, 0), term) AS INTEGER) AS rnk FROM qt LEFT JOIN dfs USING (term)")
def rarest_first(spark, d):
    terms = spark.createDataFrame([(t,) for t in [*TERMS, "zzz"]], "term string")
    return I.rarest_first(terms, term_table(spark, d))


def _topk(order: str, where: str = "true") -> str:
    return f"WITH {POSTINGS} SELECT term, post_id, CAST(row_number() OVER (PARTITION BY term ORDER BY {order}) AS INTEGER) AS rnk FROM postings WHERE term IN {inn(TERMS)} AND {where} QUALIFY row_number() OVER (PARTITION BY term ORDER BY {order}) <= 50"


def _slice(spark, d):
    return postings(spark, d).filter(F.col("term").isin(TERMS))


@query(_topk("bucket DESC, post_id"))
def impact_topk(spark, d):
    return I.ranked_reads(_slice(spark, d), I.impact_order(), 50).select("term", "post_id", "rnk")


@query(_topk("created_ms DESC, post_id", f"created_ms >= {FROM} AND created_ms < {NOW}"))
def latest_topk(spark, d):
    rows = _slice(spark, d).filter(S.hard_filters({"since": FROM, "until": NOW}))
    return I.ranked_reads(rows, I.time_order(), 50).select("term", "post_id", "rnk")


@query(_topk("created_ms DESC, post_id", "author_id = '40417'"))
def author_topk(spark, d):
    return I.ranked_reads(_slice(spark, d).filter("author_id = '40417'"), I.time_order(), 50).select("term", "post_id", "rnk")


@query(_topk("bucket DESC, post_id", "media_type = 'image'"))
def media_topk(spark, d):
    return I.ranked_reads(_slice(spark, d).filter("media_type = 'image'"), I.impact_order(), 50).select("term", "post_id", "rnk")


@query(f"WITH {POSTS} SELECT post_id, created_ms FROM posts WHERE author_id = '40417' ORDER BY created_ms DESC, post_id LIMIT 500")
def author_timeline(spark, d):
    return posts(spark, d).filter("author_id = '40417'").orderBy(*I.time_order()).limit(I.PER_TERM_CAP).select("post_id", "created_ms")


# ---- joins
@query(f"WITH {POSTINGS} SELECT post_id, term, tf, posts.text, posts.likes FROM postings JOIN posts USING (post_id) WHERE term IN {inn(MUST)}")
def hydrate_posts(spark, d):
    p = posts(spark, d)
    hits = postings(spark, d).filter(F.col("term").isin(MUST))
    return hits.select("post_id", "term", "tf").join(p.select("post_id", "text", "likes"), "post_id").select("post_id", "term", "tf", "text", "likes")


@query(f"WITH {POSTS}, {AUTHORS} SELECT post_id, author_id, display_name, verified FROM posts LEFT JOIN latest_authors USING (author_id)")
def posts_with_author(spark, d):
    return posts(spark, d).join(latest_authors(spark, d), "author_id", "left").select("post_id", "author_id", "display_name", "verified")


@query(f"WITH {POSTS}, {AUTHORS} SELECT author_id, false AS stub FROM latest_authors UNION ALL SELECT DISTINCT author_id, true FROM posts ANTI JOIN latest_authors USING (author_id) WHERE author_id IS NOT NULL")
def stub_authors(spark, d):
    return A.stub_authors(posts(spark, d), latest_authors(spark, d))


VOTES = "votes AS (SELECT query_key, candidate_id, CAST(max(coalesce(feedback_votes, 0)) AS BIGINT) AS total FROM candidates GROUP BY ALL)"


@query(f"WITH {POSTS}, {VOTES} SELECT post_id, coalesce(total, 0) AS total FROM posts LEFT JOIN (SELECT candidate_id AS post_id, sum(total)::BIGINT AS total FROM votes GROUP BY ALL) v USING (post_id)")
def feedback_join(spark, d):
    votes = table(spark, d, "candidates").groupBy("query_key", "candidate_id").agg(F.max(F.coalesce("feedback_votes", F.lit(0))).cast("long").alias("total"))
    per = votes.groupBy(F.col("candidate_id").alias("post_id")).agg(F.sum("total").alias("total"))
    return posts(spark, d).select("post_id").join(per, "post_id", "left").select("post_id", F.coalesce("total", F.lit(0)).alias("total"))


# ---- ranking
IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"
N_ = "tot AS (SELECT count(*) AS n FROM posts)"
REL = f"rel AS (SELECT post_id, sum({IDF} * tf * 1.3 / (tf + 0.3)) AS rel FROM postings JOIN dfs USING (term), tot WHERE term IN {inn([*MUST, *SOFT])} GROUP BY post_id)"


@query(f"WITH {POSTINGS}, {N_}, {REL} SELECT post_id, round(rel, 6) AS rel FROM rel")
def bm25_rank(spark, d):
    p = analysed(spark, d)
    terms = postings(spark, d).select("post_id", "term", "tf")
    wanted = [*MUST, *SOFT]
    return R.relevance(terms.filter(F.col("term").isin(wanted)), term_table(spark, d), p.count()).withColumn("rel", F.round("rel", 6))


@query(f"WITH {POSTINGS}, lists AS (SELECT post_id, row_number() OVER (PARTITION BY term ORDER BY bucket DESC, post_id) AS rnk FROM postings WHERE term IN {inn(TERMS)} QUALIFY rnk <= 500) SELECT post_id, round(sum(1.0 / (60 + rnk)), 6) AS rrf FROM lists GROUP BY post_id")
def rrf_fusion(spark, d):
    return R.rrf(I.ranked_reads(_slice(spark, d), I.impact_order())).withColumn("rrf", F.round("rrf", 6))


CAND = f"""c0 AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY query_key, candidate_id ORDER BY cand_seq) = 1),
z AS (SELECT *, CASE WHEN propagated_boost IS NULL OR isnan(propagated_boost) THEN 0.0 ELSE propagated_boost END AS pb, CASE WHEN author_authority IS NULL OR isnan(author_authority) THEN 0.0 ELSE author_authority END AS aa FROM c0),
s AS (SELECT *, ln(1 + coalesce(like_count, 0) + 2.0 * coalesce(reply_count, 0) + 3.0 * coalesce(retweet_count, 0) + 4.0 * coalesce(quote_count, 0) + greatest(0.0, pb)) AS e, greatest(0.0, aa) AS a FROM z),
parts AS (SELECT *, CAST(0.35 AS DOUBLE) AS p_rel, 0.2 * e / greatest(max(e) OVER w, 1e-9) AS p_eng, 0.1 * a / greatest(max(a) OVER w, 1e-9) AS p_auth,
 0.15 * exp(-greatest(0, {NOW} - coalesce(created_at, {NOW})) / 172800000.0) AS p_rec, 0.1 * least(greatest(CAST(coalesce(feedback_votes, 0) AS DOUBLE), -5.0), 5.0) / 5 AS p_fb, CAST(0.1 * CASE WHEN media_type = 'image' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS p_fit
 FROM s WINDOW w AS (PARTITION BY query_key)),
scored AS (SELECT *, p_rel + p_eng + p_auth + p_rec + p_fb + p_fit AS score, coalesce(retweet_of_tweet_id, quoted_tweet_id, candidate_id) AS chain FROM parts)"""


def _scored_candidates(spark, d):
    c = table(spark, d, "candidates")
    one = c.join(c.groupBy("query_key", "candidate_id").agg(F.min("cand_seq").alias("cand_seq")), ["query_key", "candidate_id", "cand_seq"], "left_semi")
    fit = F.when(F.col("media_type") == "image", R.FIT_MEDIA).otherwise(0.0)
    ready = one.withColumns({"rel": F.lit(1.0), "fit": fit, "cover": F.lit(1.0), "chain": R.chain_key("candidate_id", "retweet_of_tweet_id", "quoted_tweet_id")})
    return R.six_signals(ready, NOW, "top", ["query_key"])


SIX = ["p_rel", "p_eng", "p_auth", "p_rec", "p_fb", "p_fit", "score"]


@query(f"WITH {CAND} SELECT query_key, candidate_id, {', '.join(f'round({c}, 6) AS {c}' for c in SIX)} FROM scored")
def rerank_scores(spark, d):
    return _scored_candidates(spark, d).select("query_key", "candidate_id", *[F.round(c, 6).alias(c) for c in SIX])


CAND_ORDER = "CASE WHEN matched_via = 'L0' THEN 0 ELSE 1 END, score DESC, candidate_id"


@query(f"WITH {CAND} SELECT query_key, chain, candidate_id, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY query_key, chain ORDER BY {CAND_ORDER}) = 1")
def chain_dedup(spark, d):
    best = R.best_of_chains(_scored_candidates(spark, d), "candidate_id", ["query_key"])
    return best.select("query_key", "chain", "candidate_id", F.round("score", 6).alias("score"))


def _search_sql(sort: str) -> str:
    tau = 48 * 3600000.0 if sort == "top" else 6 * 3600000.0
    order = "cover DESC, score DESC, post_id" if sort == "top" else "created_ms DESC, score DESC, post_id"
    read = "bucket DESC, post_id" if sort == "top" else "created_ms DESC, post_id"
    return f"""WITH {POSTINGS}, {N_}, {AUTHORS}, {BOOSTED.removeprefix(POSTS + ', ')},
rare AS (SELECT term FROM dfs WHERE term IN {inn(MUST)} ORDER BY df, term LIMIT 1),
seed AS (SELECT post_id FROM postings WHERE term = (SELECT term FROM rare) QUALIFY row_number() OVER (PARTITION BY term ORDER BY {read}) <= 1500),
pairs_read AS (SELECT post_id, row_number() OVER (PARTITION BY term ORDER BY {read}) AS r FROM postings WHERE term = chr(2) || 'security' || chr(2) || 'leaks' QUALIFY r <= 500),
fused AS (SELECT post_id, sum(w) AS rrf FROM (SELECT post_id, 0.0 AS w FROM seed UNION ALL SELECT post_id, 1.0 / (60 + r) FROM pairs_read) GROUP BY post_id),
cand AS (SELECT ana.*, rrf FROM ana JOIN fused USING (post_id) WHERE list_contains(tokens, 'security') AND list_contains(tokens, 'leaks') ORDER BY rrf DESC, post_id LIMIT 200),
rel AS (SELECT post_id, sum({IDF} * tf * 1.3 / (tf + 0.3)) AS rel FROM postings JOIN dfs USING (term) JOIN cand USING (post_id), tot WHERE term IN {inn([*MUST, *SOFT])} GROUP BY post_id),
raw AS (SELECT cand.*, rel, ln(1 + likes + 2 * replies + 3 * retweets + 4 * quotes + greatest(0.0, coalesce(boost, 0))) AS e, ln(1 + coalesce(follower_count, 0)) AS a,
 0.3 + CASE WHEN list_contains(tokens, 'update') THEN 0.2 ELSE 0 END AS fit, coalesce(retweet_of_id, quoted_id, post_id) AS chain, 1.0 AS cover
 FROM cand JOIN rel USING (post_id) LEFT JOIN boosts USING (post_id) LEFT JOIN latest_authors USING (author_id)),
scored AS (SELECT *, 0.35 * rel / greatest(max(rel) OVER (), 1e-9) + 0.2 * e / greatest(max(e) OVER (), 1e-9) + 0.1 * a / greatest(max(a) OVER (), 1e-9) + 0.15 * exp(-greatest(0, {NOW} - created_ms) / {tau}) + 0.1 * fit AS score FROM raw),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY chain ORDER BY {order}) = 1)
SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rnk, post_id, 'L0' AS level, round(score, 6) AS score FROM best"""


def engine(spark, d) -> SearchEngine:
    """The engine over the kept tables, with authors' authority and boosts."""
    known = latest_authors(spark, d).withColumn("authority", F.log1p(F.coalesce("follower_count", F.lit(0)).cast("double")))
    built = lambda name, table: kept(spark, d, name, lambda: table)
    authors = built("authority", known.select("author_id", "handle", "authority"))
    return SearchEngine(analysed(spark, d), postings(spark, d), term_table(spark, d), authors, boosts=built("boosts", P.propagated_boosts(posts(spark, d))))


def _search(spark, d, sort: str) -> DataFrame:
    """L0 of ``MUST`` with a soft term, ranked."""
    e = engine(spark, d)
    df, floors = e._frequencies({*MUST, *SOFT, f"{X.BIGRAM}{MUST[0]}{X.BIGRAM}{MUST[1]}"})
    q = Query(must=MUST, should=SOFT, sort=sort)
    one = Search(0, q, plan.first_plan(q, df), df)
    e.climb([one], floors, steps=1)
    best = B.ranked(e._ranked([one], NOW, {}).drop("rnk"))
    return best.select("rnk", "post_id", F.col("matched_via").alias("level"), F.round("score", 6).alias("score"))


@query()
def engine_search(spark, d):
    """A batch of typed queries through the whole engine: parsed, planned, widened level by level, ranked."""
    results, pages = engine(spark, d).search_many(QUERIES_RAW, NOW)
    raws = B.local_rows(spark, [{"qid": i, "raw": raw, "ladder": " ".join(r.ladder)} for i, (raw, r) in enumerate(zip(QUERIES_RAW, results, strict=True))], "qid int, raw string, ladder string")
    return pages.join(F.broadcast(raws), "qid").select("raw", "ladder", "rnk", "post_id", F.col("matched_via").alias("level"), F.round("score", 6).alias("score"))


def _window(order):
    from pyspark.sql import Window

    return Window.orderBy(*order)


@query(_search_sql("top"))
def search_top(spark, d):
    return _search(spark, d, "top")


@query(_search_sql("latest"))
def search_latest(spark, d):
    return _search(spark, d, "latest")


LADDER = ["security", "leaks", "changelog"]


@query(f"""WITH {POSTINGS}, gate AS (SELECT term, row_number() OVER (ORDER BY df, term) AS g FROM dfs WHERE term IN {inn(LADDER)}),
hit AS (SELECT post_id, count(*) AS n, count(*) FILTER (g = 1) AS g1, count(*) FILTER (g <= 2) AS g2 FROM postings JOIN gate USING (term) GROUP BY post_id)
SELECT post_id, CASE WHEN n = 3 THEN 'L0' WHEN g2 = 2 OR g1 = 1 THEN 'L1' ELSE 'L2' END AS level FROM hit""")
def ladder_search(spark, d):
    """Each level as a relation, uncapped: all gates; then without the commonest gate, twice; then any term."""
    terms = postings(spark, d)
    gates = I.rarest_first(spark.createDataFrame([(t,) for t in LADDER], "term string"), term_table(spark, d))
    hits = terms.join(F.broadcast(gates.select("term", "rnk")), "term")  # one row per query term
    n = hits.groupBy("post_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rnk") == 1).alias("g1"), F.count_if(F.col("rnk") <= 2).alias("g2"))
    level = F.when(F.col("n") == len(LADDER), "L0").when((F.col("g2") == 2) | (F.col("g1") == 1), "L1").otherwise("L2")
    return n.select("post_id", level.alias("level"))


@query(f"""WITH {POSTINGS}, top AS (SELECT post_id FROM postings WHERE term = 'security' ORDER BY bucket DESC, post_id LIMIT 20),
w AS (SELECT DISTINCT post_id, unnest(tokens) AS term FROM tok JOIN top USING (post_id))
SELECT term, count(*) AS n FROM w WHERE term <> 'security' AND length(term) >= 3 AND NOT starts_with(term, '~') GROUP BY term HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT 5""")
def prf_terms(spark, d):
    p = analysed(spark, d)
    top = postings(spark, d).filter("term = 'security'").orderBy(*I.impact_order()).limit(20).select("post_id")
    return S.feedback_terms(p.join(top, "post_id", "left_semi"), ["security"])


@query(f"""WITH {CAND}, r AS (SELECT query_key, candidate_id AS post_id, chain, row_number() OVER (PARTITION BY query_key ORDER BY {CAND_ORDER}) AS rnk FROM scored), pin AS (SELECT * FROM r WHERE rnk IN (3, 7, 11)),
tail AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM pin WHERE pin.query_key = r.query_key AND (pin.post_id = r.post_id OR pin.chain = r.chain)))
SELECT query_key, post_id, 'pinned' AS section, CAST(row_number() OVER (PARTITION BY query_key ORDER BY rnk DESC) AS INTEGER) AS pos FROM pin UNION ALL
SELECT query_key, post_id, 'tail', CAST(row_number() OVER (PARTITION BY query_key ORDER BY rnk) + (SELECT count(*) FROM pin WHERE pin.query_key = tail.query_key) AS INTEGER) FROM tail""")
def pinned_paging(spark, d):
    """The page of every query, each with three rows that stay where they were shown."""
    ranked = Window.partitionBy("query_key").orderBy(*R.final_order("candidate_id"))
    r = _scored_candidates(spark, d).select("query_key", F.col("candidate_id").alias("post_id"), "chain", F.row_number().over(ranked).alias("rnk"))
    pinned = r.filter(F.col("rnk").isin(3, 7, 11)).select("query_key", "post_id", "chain", (-F.col("rnk")).alias("shown"))
    return R.merge_pinned(pinned, r, by=["query_key"])


@query(f"WITH {POSTINGS}, f AS (SELECT term, df FROM dfs WHERE starts_with(term, 'se') ORDER BY term LIMIT 50) SELECT term, df, 'term' AS kind FROM f ORDER BY df DESC, term LIMIT 10")
def suggest_terms(spark, d):
    return S.suggest_terms(term_table(spark, d), "se").withColumn("kind", F.lit("term"))


@query(f"WITH {AUTHORS}, f AS (SELECT author_id, handle, ln(1 + coalesce(follower_count, 0)) AS authority FROM latest_authors WHERE starts_with(handle, 's') ORDER BY handle, author_id LIMIT 20) SELECT handle, author_id, 'author' AS kind FROM f ORDER BY authority DESC, handle, author_id LIMIT 10")
def suggest_authors(spark, d):
    known = latest_authors(spark, d).withColumn("authority", F.log1p(F.coalesce("follower_count", F.lit(0)).cast("double")))
    return S.suggest_authors(known, "s").select("handle", "author_id", F.lit("author").alias("kind"))


def _lane_sql(must: list[str], limit: int) -> str:
    return f"""WITH {TOKENS}, st AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM tok),
w AS (SELECT post_id, len(tokens) AS length, unnest(tokens) AS term FROM tok), tf AS (SELECT post_id, length, term, count(*) AS tf FROM w WHERE term IN {inn(must)} GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
h AS (SELECT post_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score, count(*) AS k FROM tf JOIN df USING (term), st GROUP BY post_id)
SELECT post_id, round(score, 6) AS score, count(*) OVER () AS total FROM h WHERE k = {len(must)} ORDER BY score DESC, post_id LIMIT {limit}"""


@query(_lane_sql(["changelog"], 20))
def baseline_search(spark, d):
    return S.second_lane(analysed(spark, d), ["changelog"], 20).withColumn("score", F.round("score", 6))


@query(_lane_sql(["security", "leaks"], 50))
def bm25_second_lane(spark, d):
    return S.second_lane(analysed(spark, d), MUST, 50).withColumn("score", F.round("score", 6))


@query(f"WITH {POSTS} SELECT post_id, regexp_replace(text, '(?i)\\b(security|leaks)\\b', '[\\1]', 'g') AS marked FROM posts WHERE regexp_matches(text, '(?i)\\b(security|leaks)\\b')")
def highlight_terms(spark, d):
    marked = X.highlighted(F.col("text"), MUST)
    return posts(spark, d).select("post_id", "text", marked.alias("marked")).filter(F.col("marked") != F.col("text")).select("post_id", "marked")


AT = 1757289600000  # 2025-09-08, when the tables' first posts were young
_DUE = "greatest(" + ", ".join(f"CASE WHEN created_ms + {h * 3600000} <= {AT} THEN created_ms + {h * 3600000} END" for h in P.RECRAWL_HOURS) + ")"


@query(f"WITH {POSTS} SELECT post_id, {_DUE} AS due_ms FROM posts WHERE created_ms > {AT} - 72 * 3600000 AND metrics_at < {_DUE}")
def recrawl_due(spark, d):
    return P.recrawl_due(posts(spark, d), AT)


@query(f"WITH {POSTS} SELECT post_id FROM posts ORDER BY md5('7:' || post_id), post_id LIMIT 100")
def corpus_sample(spark, d):
    return P.sample_posts(posts(spark, d), 100, 7).select("post_id")


#: Times in queries and what they mean at ``NOW``, as SQL: the first instant in, the first one after.
_TIMES = [
    ("x since:2026-02-28", "epoch_ms(TIMESTAMP '2026-02-28')", "NULL"),
    ("x since:7d until:12h", f"{NOW} - 7 * 86400000::BIGINT", f"{NOW} - 12 * 3600000"),
    ("x since:2w", f"{NOW} - 14 * 86400000::BIGINT", "NULL"),
    ("x since:2026-02-30", "NULL", "NULL"),
    ("x today", "epoch_ms(TIMESTAMP '2026-09-07')", "NULL"),
    ("x yesterday", "epoch_ms(TIMESTAMP '2026-09-06')", "epoch_ms(TIMESTAMP '2026-09-07')"),
    ("x last week", f"{NOW} - 7 * 86400000::BIGINT", "NULL"),
    ("x this month", f"{NOW} - 30 * 86400000::BIGINT", "NULL"),
    ("x in 2024", "epoch_ms(TIMESTAMP '2024-01-01')", "epoch_ms(TIMESTAMP '2025-01-01')"),
    ("x in march", "epoch_ms(TIMESTAMP '2026-03-01')", "epoch_ms(TIMESTAMP '2026-04-01')"),
    ("x during december", "epoch_ms(TIMESTAMP '2025-12-01')", "epoch_ms(TIMESTAMP '2026-01-01')"),
    ("x before june 2025", "NULL", "epoch_ms(TIMESTAMP '2025-06-01')"),
    ("x since june", "epoch_ms(TIMESTAMP '2026-06-01')", "NULL"),
    ("x this winter", "epoch_ms(TIMESTAMP '2025-12-01')", "epoch_ms(TIMESTAMP '2026-03-01')"),
    ("x last summer", "epoch_ms(TIMESTAMP '2025-06-01')", "epoch_ms(TIMESTAMP '2025-09-01')"),
    ("long march", "NULL", "NULL"),
]
_TIME_ROWS = ", ".join(f"({q(raw)}, CAST({since} AS BIGINT), CAST({until} AS BIGINT))" for raw, since, until in _TIMES)


@query(f"SELECT * FROM (VALUES {_TIME_ROWS}) t(raw, since, until)")
def date_readings(spark, d):
    """What times in queries mean: given, relative, named."""
    rows = [{"raw": raw, **{k: parse(raw, NOW).filters[k] for k in ("since", "until")}} for raw, _, _ in _TIMES]
    return B.local_rows(spark, rows, "raw string, since bigint, until bigint")
