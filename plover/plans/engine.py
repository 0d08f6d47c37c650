"""The search engine: parse, plan, read, verify, widen, rank, page; and the write side that keeps its tables.

Queries run in batches, one Spark job a ladder level for all that still widen (``operators.batch``). The driver sees
document frequencies of the queries' words and at most ``index.RERANK_CAP`` ids a query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.functions.text import tokenize
from plover.operators import batch as B
from plover.operators import index as I
from plover.operators import ingest
from plover.operators import posts as P
from plover.operators import search as S
from plover.plans import ir, parse, plan
from plover.runtime import materialize

MAX_TERMS = 12
MAX_STEPS = 5
DEFAULT_LIMIT = 20
#: How far ahead of the clock a caller's snapshot time may be.
SKEW_MS = 60_000
COMMON_NAME = 200


@dataclass
class Result:
    error: str | None = None
    query_key: str | None = None
    query: ir.Query | None = None
    as_of: int | None = None
    ladder: list[str] = field(default_factory=list)
    results: list[dict] = field(default_factory=list)
    candidate_count: int = 0
    next_prefix: list[tuple[str, str]] = field(default_factory=list)
    prefix_dropped: bool = False
    did_you_mean: str | None = None


@dataclass
class Search:
    """A query on its way through the ladder."""

    qid: int
    query: ir.Query
    plan: plan.Plan | None
    df: dict[str, int]
    level: dict[str, str] = field(default_factory=dict)
    ladder: list[str] = field(default_factory=list)
    checks_only: bool = False

    @property
    def words(self) -> list[str]:
        q = self.query
        return list(dict.fromkeys([*q.must, *q.should, *q.aspects, *plan.phrase_terms(q)]))

    def spec(self, total: int, floors: dict[str, tuple[int, int]]) -> dict:
        q, p = self.query, self.plan
        reads = []
        if p is not None:
            if p.gates:
                cap = I.SEED_CAP if len(p.gates) > 1 else I.PER_TERM_CAP
                reads.append(("gate", p.gates[0], cap))
            reads += [("union", t, I.PER_TERM_CAP) for t in p.unions]
        idf = lambda t: float(np.log((total - self.df.get(t, 0) + 0.5) / (self.df.get(t, 0) + 0.5) + 1))
        floor = lambda t, cap: floors.get(t, (0, 0))[cap == I.SEED_CAP] if p.read == "impact" else None
        return {
            **{k: v for k, v in q.filters.items()},
            "qid": self.qid, "sort": q.sort, "intent": q.intent, "union": q.union, "must": q.must, "should": q.should, "phrases": q.phrases, "exclude": q.exclude, "key": ir.query_key(q),
            "pairs": plan.query_pairs(q, self.df), "phrase_words": sorted({w for x in q.phrases for w in x}), "gates": list(p.gates) if p else [], "have": list(self.level), "room": I.RERANK_CAP - len(self.level),
            "terms": [{"term": t, "idf": idf(t)} for t in self.words if self.df.get(t)],
            "reads": [{"role": r, "term": t, "cap": c, "read": p.read, "floor": floor(t, c)} for r, t, c in reads],
        }


class SearchEngine:
    """Search over ``posts`` (operators.posts). What isn't given is built: ``postings`` (``index.sorted_postings``), ``terms``
    (``index.term_table``). ``authors``: author_id, handle, authority. ``votes``: query_key, post_id, total. ``boosts``: post_id, boost."""

    def __init__(self, posts: DataFrame, postings: DataFrame | None = None, terms: DataFrame | None = None, authors: DataFrame | None = None, votes: DataFrame | None = None, boosts: DataFrame | None = None):
        self.spark = posts.sparkSession
        self.posts = posts if "present" in posts.columns else materialize(I.analysed(posts), "analysed")  # queries never reach the tokenizer
        self.postings = postings if postings is not None else materialize(I.sorted_postings(I.postings_of(self.posts)), "postings")
        self.terms = terms if terms is not None else materialize(I.term_table(self.postings), "terms")
        self.authors, self.votes, self.boosts = authors, votes, boosts
        self.ballots: DataFrame | None = None
        self.total = self.posts.count()

    # ---- lookups of a batch
    def _frequencies(self, words: set[str]) -> tuple[dict[str, int], dict[str, tuple[int, int]]]:
        rows = self.terms.filter(F.col("term").isin(sorted(words) or [""])).select("term", "df", "floor_read", "floor_seed").collect()
        return {r.term: r.df for r in rows}, {r.term: (r.floor_read, r.floor_seed) for r in rows}

    def _handles(self, words: set[str]) -> dict[str, str]:
        if self.authors is None or not words:
            return {}
        found = self.authors.filter(F.col("handle").isin(sorted(words))).groupBy("handle").agg(F.min("author_id").alias("author_id"))
        return {r.handle: r.author_id for r in found.collect()}

    @staticmethod
    def snapshot(now_ms: int, as_of: int | None) -> int:
        """The time a page sequence is ranked at: the caller's, unless it is none or ahead of the clock."""
        return as_of if as_of is not None and 0 < as_of <= now_ms + SKEW_MS else now_ms

    # ---- searching
    def search(self, raw: str, *, now_ms: int, sort: str | None = None, limit: int | None = None, as_of: int | None = None, prefix: list | None = None, prefix_key: str | None = None) -> Result:
        at = self.snapshot(now_ms, as_of)
        if prefix and len(prefix) > I.RERANK_CAP:
            return Result(error="too many pinned rows")
        (out,), searches = self._read([raw], at, sort)
        if not searches:
            return out
        limit = max(1, min(I.RERANK_CAP, DEFAULT_LIMIT if limit is None else int(limit)))
        search = searches[0]
        shown = [p if isinstance(p, tuple) else (p, "L1") for p in prefix or []]
        out.prefix_dropped = bool(shown) and prefix_key != out.query_key
        pinned = {} if out.prefix_dropped else self._still_fit(search, dict(shown))
        ranked = self._ranked(searches, at, {search.qid: pinned}).collect()
        by_id = {r.post_id: r.asDict() for r in ranked}
        kept = [by_id[i] for i in pinned if i in by_id]
        chains = {r["chain"] for r in kept}
        best: dict[str, dict] = {}
        for r in sorted(by_id.values(), key=lambda r: r["rnk"]):  # of a chain the first; pinned rows stand for theirs
            if r["chain"] not in chains:
                best.setdefault(r["chain"], r)
        page = kept + list(best.values())
        out.candidate_count = min(len(page), I.RERANK_CAP)
        out.results = page[:limit]
        out.next_prefix = [(r["post_id"], r["matched_via"]) for r in out.results]
        return out

    def search_many(self, raws: list[str], now_ms: int, sort: str | None = None) -> tuple[list[Result], DataFrame]:
        """Results without their rows, and the pages: qid (place in ``raws``), rnk, post_id, matched_via, score. All queries of
        a batch of ``batch.MAX_BATCH`` share the jobs."""
        results, pages = [], []
        for at in range(0, len(raws), B.MAX_BATCH):
            found, searches = self._read(raws[at : at + B.MAX_BATCH], now_ms, sort, first=at)
            results += found
            pages.append(B.ranked(self._ranked(searches, now_ms, {}).drop("rnk")).select("qid", "rnk", "post_id", "matched_via", "score"))
        out = pages[0]
        for page in pages[1:]:
            out = out.unionByName(page)
        return results, out

    def _read(self, raws: list[str], now_ms: int, sort: str | None, first: int = 0) -> tuple[list[Result], list[Search]]:
        """Parse and climb the ladder: results (errors, keys, levels) and the searches that found their candidates."""
        results = [Result(error=parse.check_input(raw), as_of=now_ms) for raw in raws]
        words = {i: tokenize(raw, keep_stopwords=True) for i, raw in enumerate(raws) if not results[i].error}
        every = {w for ws in words.values() for w in ws}
        pairs = {f"{plan.BIGRAM}{a}{plan.BIGRAM}{b}" for ws in words.values() for i, a in enumerate(ws) for b in ws[i + 1 :]}
        named = {m.removeprefix("@").lower() for raw in raws for m in re.findall(r"(?i)\bfrom:(\S+)", raw)}
        handles = self._handles(every | named)
        df, floors = self._frequencies(every | pairs | set(parse.aspect_names()))
        searches = []
        for i in words:
            q = parse.parse(raws[i], now_ms, handles.get, lambda w: handles.get(w) if df.get(w, 0) < COMMON_NAME else None)
            if sort and "sort" not in q.consumed.values():
                q.sort = sort
            results[i].query, results[i].query_key = q, ir.query_key(q)
            s = Search(first + i, q, plan.first_plan(q, df), df)
            if any(x.startswith("from:") for x in q.leftover):
                results[i].error = "unknown author"
            elif len(s.words) > MAX_TERMS:
                results[i].error = f"too many terms and aspects (over {MAX_TERMS})"
            else:
                searches.append(s)
        self.climb(searches, floors)
        by = {s.qid: s for s in searches}
        for i, raw in enumerate(raws):
            if s := by.get(first + i):
                results[i].ladder = s.ladder
        starving = [s for s in searches if len(s.level) < plan.MIN_RESULTS]
        near = {s.qid: self._neighbours(s) for s in starving}
        known = self._frequencies({n for of in near.values() for ns in of.values() for n in ns})[0] if any(near.values()) else {}
        for s in starving:
            results[s.qid - first].did_you_mean = self._repair(raws[s.qid - first], near[s.qid], known)
        return results, searches

    def climb(self, searches: list[Search], floors: dict[str, tuple[int, int]], steps: int = MAX_STEPS) -> None:
        """Run the ladder of all searches, level by level; each keeps the level its rows first matched at."""
        authors_only = [s for s in searches if not s.plan.gates and not s.plan.unions]
        for s in authors_only:
            s.plan = None
        if timed := [s for s in authors_only if s.query.filters["authorId"] is not None]:
            specs = self._specs(timed, floors)
            self._accept(B.verified(self.posts, B.timelines(self.posts, specs), specs), timed, "L0")
        for _ in range(steps):
            active = [s for s in searches if s.plan is not None]
            if not active:
                break
            specs = self._specs(active, floors)
            wanted: dict[str, int | None] = {}
            for s in active:
                for r in s.spec(self.total, floors)["reads"]:
                    low = r["floor"] if s.plan.read == "impact" else None
                    old = wanted.get(r["term"], 256)
                    wanted[r["term"]] = None if low is None or old is None else min(low, old)
            found = B.candidates(B.index_slice(self.postings, wanted), specs)
            if len(active) * (I.SEED_CAP + MAX_TERMS * I.PER_TERM_CAP) <= 100_000:
                found = F.broadcast(found)  # bounded by the caps
            self._accept(B.verified(self.posts, found, specs), active, None)
            mined = self._mined([s for s in active if s.plan.level == "L2" and 0 < len(s.level) < plan.MIN_RESULTS], floors)
            for s in active:
                s.ladder.append(s.plan.level)
                s.plan = plan.wider(s.plan, len(s.level), s.query, s.df, mined.get(s.qid, []))

    def _specs(self, searches: list[Search], floors: dict) -> DataFrame:
        return B.local_rows(self.spark, [s.spec(self.total, floors) for s in searches], B.SPEC)

    @staticmethod
    def _accept(rows: DataFrame, searches: list[Search], level: str | None) -> None:
        by = {s.qid: s for s in searches}
        for r in sorted(rows.collect(), key=lambda r: (r.qid, r.place)):  # at most RERANK_CAP a query
            by[r.qid].level[r.post_id] = level or by[r.qid].plan.level

    def _mined(self, searches: list[Search], floors: dict) -> dict[int, list[str]]:
        if not searches:
            return {}
        top = B.local_rows(self.spark, [{"qid": s.qid, "post_id": i} for s in searches for i in list(s.level)[:20]], "qid int, post_id string")
        specs = B.local_rows(self.spark, [{"qid": s.qid, "terms": [{"term": t, "idf": 0.0} for t in s.words]} for s in searches], B.SPEC)
        out: dict[int, list[str]] = {}
        for r in sorted(B.feedback(self.posts, top, specs).collect(), key=lambda r: (r.qid, r.k)):
            out.setdefault(r.qid, []).append(r.term)
        df, low = self._frequencies({t for ts in out.values() for t in ts})
        floors.update(low)
        for s in searches:
            s.df = s.df | df
        return out

    def _still_fit(self, search: Search, shown: dict[str, str]) -> dict[str, str]:
        """Pinned rows that still satisfy the query: its filters and words, those of level L0 its gates too."""
        if not shown:
            return {}
        gates = list(plan.first_plan(search.query, search.df).gates)
        probe = {**search.spec(self.total, {}), "have": [], "room": I.RERANK_CAP, "reads": []}
        exact = [i for i, via in shown.items() if via == "L0"]
        specs = B.local_rows(self.spark, [{**probe, "qid": 0, "gates": gates}, {**probe, "qid": 1, "gates": []}], B.SPEC)
        rows = B.local_rows(self.spark, [{"qid": int(i not in exact), "post_id": i, "rrf": 0.0} for i in shown], "qid int, post_id string, rrf double")
        live = {r.post_id for r in B.verified(self.posts, F.broadcast(rows), specs).collect()}
        return {i: via for i, via in shown.items() if i in live}

    def _ranked(self, searches: list[Search], now_ms: int, extra: dict[int, dict[str, str]]) -> DataFrame:
        """Scored candidates with their place ``rnk`` before chains are reduced."""
        found = [{"qid": s.qid, "post_id": i, "matched_via": via} for s in searches for i, via in {**extra.get(s.qid, {}), **s.level}.items()]
        hits = B.local_rows(self.spark, found, "qid int, post_id string, matched_via string")
        specs = B.local_rows(self.spark, [s.spec(self.total, {}) for s in searches], B.SPEC).drop("reads", "have", "room", "gates", "lang", "since", "until", "minLikes")
        rows = self.posts.join(F.broadcast(hits), "post_id").join(F.broadcast(specs), "qid").withColumn("now_ms", F.lit(now_ms))

        def fetched(rows: DataFrame, source: DataFrame | None, keys: list[str], column: str, name: str) -> DataFrame:
            if source is None:
                return rows.withColumn(name, F.lit(0.0))
            return rows.join(source.select(*keys, F.col(column).alias(name)).dropDuplicates(keys), keys, "left")

        rows = fetched(rows, self.authors, ["author_id"], "authority", "author_authority")
        rows = fetched(rows, self.boosts, ["post_id"], "boost", "propagated_boost")
        rows = fetched(rows, self.votes.withColumnRenamed("query_key", "key") if self.votes is not None else None, ["key", "post_id"], "total", "feedback_votes")
        scored = B.scored(rows)
        keep = ["qid", "post_id", "text", "author_id", "created_at", "matched_via", "sort", "cover", "score", "chain", *[c for c in scored.columns if c.startswith("p_")]]
        return scored.selectExpr(*keep, f"{B.PLACE} AS rnk")

    @staticmethod
    def _neighbours(s: Search) -> dict[str, list[str]]:
        unknown = sorted((t for t in s.words if not s.df.get(t) and not t.startswith("~")), key=lambda t: (-len(t), t))[:2]
        return {bad: plan.repair_neighbours(bad)[:64] for bad in unknown}

    @staticmethod
    def _repair(raw: str, near: dict[str, list[str]], known: dict[str, int]) -> str | None:
        for bad, candidates in near.items():
            if found := [t for t in candidates if known.get(t)]:
                best = min(found, key=lambda t: (-known[t], t))
                return re.sub(rf"\b{re.escape(bad)}\b", lambda _: best, raw, count=1, flags=re.I)
        return None

    def suggest(self, prefix: str, mode: str = "both") -> list[dict]:
        prefix = prefix[:64].lower()
        out = []
        if mode in ("term", "both"):
            out += [{"term": r["term"], "df": r["df"], "kind": "term"} for r in S.suggest_terms(self.terms, prefix, 7 if mode == "both" else 10).collect()]
        if mode in ("author", "both") and self.authors is not None:
            words = {o["term"] for o in out}
            found = S.suggest_authors(self.authors, prefix.removeprefix("@"), 3 if mode == "both" else 10).collect()
            out += [{"term": r["handle"], "df": 0, "kind": "author"} for r in found if r["handle"] not in words]
        return out

    def baseline(self, raw: str, limit: int = 20) -> DataFrame:
        return S.second_lane(self.posts, parse.tokenize(raw), limit)

    def second_lane(self, q: str | None = None, *, author: str | None = None, since: int | None = None, until: int | None = None, limit: int = 20) -> DataFrame:
        """post_id, score, total by plain BM25: every word of ``q``, an author's id or handle, times (both bounds included)."""
        words, author = parse.tokenize(q or ""), (author or "").strip()
        if since is not None and until is not None and since > until:
            raise ValueError("since must not be after until")
        if not words and not author and since is None and until is None:
            raise ValueError("empty query: words, an author or a time range are needed")
        keep = F.lit(True)
        if author:
            keep &= F.col("author_id").isin([author, *self._handles({author.lower()}).values()])
        if since is not None:
            keep &= F.col("created_ms") >= since
        if until is not None:
            keep &= F.col("created_ms") <= until
        return S.second_lane(self.posts, words, max(1, min(I.RERANK_CAP, limit)), keep=keep)

    # ---- writing
    def ingest(self, arriving: DataFrame) -> dict[str, int]:
        """Take in posts (columns of ``operators.posts``), once: inserted, updated (newer metrics), skipped. Ingesting the same
        batch again changes nothing. A post of too many postings fails the batch before anything is taken."""
        arriving = materialize(arriving, "arriving")
        one = arriving.groupBy("post_id").agg(F.min_by(F.struct(*arriving.columns), "ingress_seq").alias("r"), F.max("metrics_at").alias("newest")).select("r.*", "newest")
        stored = self.posts.select("post_id", F.col("metrics_at").alias("_stored"))
        marked = materialize(one.join(stored, "post_id", "left").withColumn("_known", F.col("_stored").isNotNull()), "marked")
        fresh = materialize(I.analysed(marked.filter(~F.col("_known")).drop("newest", "_stored", "_known")), "fresh")
        I.check_posting_cap(fresh)
        columns, counts = self.posts.columns, [*P.COUNTS, "metrics_at"]
        latest = ingest.latest_by(arriving, "post_id", "metrics_at", "ingress_seq", counts)
        newer = materialize(latest.join(marked.filter("newest > _stored OR NOT _known").select("post_id"), "post_id"), "newer")
        outcome = {r[0]: r[1] for r in marked.groupBy(F.when(~F.col("_known"), "inserted").when(F.col("newest") > F.col("_stored"), "updated").otherwise("skipped")).count().collect()}
        self.posts = self._with_counts(self.posts.unionByName(fresh.select(columns)), newer)
        self.postings = self.postings.unionByName(I.postings_of(fresh).select(self.postings.columns))
        self._rebucket(newer.select("post_id"))
        return {k: outcome.get(k, 0) for k in ("inserted", "updated", "skipped")}

    @staticmethod
    def _with_counts(posts: DataFrame, newer: DataFrame) -> DataFrame:
        counts = [*P.COUNTS, "metrics_at"]
        new = newer.select("post_id", *[F.col(c).alias(f"_{c}") for c in counts])
        joined = posts.join(new, "post_id", "left")
        return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in counts else F.col(c) for c in posts.columns])

    def _rebucket(self, changed: DataFrame | None) -> int:
        """Write the tables anew, with the buckets of ``changed`` posts (None: of all, boosts included); only postings whose bucket moves change."""
        self.posts = materialize(self.posts, "analysed")
        scores = P.static_scores(self.posts) if changed is None else self.posts.join(changed, "post_id", "left_semi").select("post_id", P.score_bucket(P.engagement() + P.static_recency()).alias("bucket"), "likes")
        new = scores.select("post_id", F.col("bucket").alias("_bucket")).join(self.posts.select("post_id", F.col("likes").alias("_likes")), "post_id")
        joined = self.postings.join(new, "post_id", "left")
        moved = joined.filter("_bucket <> bucket").select("post_id").distinct().count()
        columns = [F.coalesce(f"_{c}", c).alias(c) if c in ("bucket", "likes") else F.col(c) for c in self.postings.columns]
        self.postings = materialize(I.sorted_postings(joined.select(*columns)), "postings")
        self.terms = materialize(I.term_table(self.postings), "terms")
        self.total = self.posts.count()
        return moved

    def refresh(self) -> int:
        """Static scores of all posts anew, with the boosts of posts that quote or repost them; how many posts' buckets moved."""
        self.boosts = materialize(P.propagated_boosts(self.posts), "boosts")
        return self._rebucket(None)

    def vote(self, ballots: DataFrame) -> dict[str, int]:
        """Votes (query_key, post_id, vote, voter, at_s, seq) under the rate limit: accepted, rejected. A voter's latest vote on a
        post and query stands; what changes none is free; anonymous ones are ignored."""
        named = ballots.filter(F.col("voter").isNotNull()).withColumn("fresh", F.lit(True))
        every = named if self.ballots is None else self.ballots.withColumn("fresh", F.lit(False)).unionByName(named)
        every = materialize(every, "votes")
        seen = ingest.rate_limited_votes(every)
        judged = materialize(every.join(seen.select("seq", "accepted"), "seq"), "judged")
        self.ballots = judged.filter("accepted OR NOT fresh").drop("fresh", "accepted")
        self.votes = materialize(ingest.vote_totals(self.ballots), "totals")
        out = {r.accepted: r["count"] for r in judged.filter("fresh").groupBy("accepted").count().collect()}
        return {"accepted": out.get(True, 0), "rejected": out.get(False, 0)}
