"""Queries: vector functions, rankings, metrics, memory and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import scalars as S
from sextant.functions import vectors as V
from sextant.operators import memory as M
from sextant.operators import metrics, permutation, retrieval, ridge, validation
from sextant.plans.register import query
from sextant.sources import tables as T
from sextant.sources.scratch import keep

K = 10
SEED = 2026
GRID = [(s, d) for s in ("ridge_only", "memory_only", "hybrid_no_decay", "hybrid") for d in (0, 1, 7, 30, 90)]
ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)
#: A fixed projection for comparisons with SQL: row r, column c of 16 x 16.
FIXED = [[((r * 7 + c * 3) % 11 - 5) / 10 for c in range(T.DIM)] for r in range(T.DIM)]


def rank_sql(queries: str, k: int = K, score: str = "round(list_inner_product(q.vector, i.item_vector), 9)") -> str:
    return f"(SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT q.query_id, i.item_id, {score} AS score FROM {queries} q, items i) QUALIFY rank <= {k})"


def metrics_sql(rankings: str, wanted: str, groups: str = "", cells: str = "") -> str:
    """Summary of rankings (groups, query_id, rank, item_id) for queries with one relevant item each.

    ``cells``: the queries of each group, a table (groups, query_id); those of the rankings if not given.
    """
    g = groups + ", " if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    asked = cells or f"(SELECT DISTINCT {g}query_id FROM {rankings})"
    return f"""SELECT {g}count(*) AS n_events, round(avg(CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_1, round(avg(CASE WHEN r IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_k, round(avg(coalesce(1.0::DOUBLE / r, 0)), 9) AS mrr,
      round(avg(coalesce(1.0::DOUBLE / log2(r + 1), 0)), 9) AS ndcg_k FROM (SELECT {g}a.query_id, min(CASE WHEN x.item_id = w.item_id THEN x.rank END) AS r FROM {asked} a JOIN {wanted} w USING (query_id) LEFT JOIN {rankings} x USING ({g}query_id) GROUP BY {g}a.query_id) {by}"""


QV = "(SELECT event_id AS query_id, {v} AS vector FROM ev WHERE split = '{s}')"
REL = "(SELECT event_id AS query_id, target_item_id AS item_id FROM ev)"


def _ranked(spark: SparkSession, d: str, split: str, vector: str) -> DataFrame:
    return retrieval.cosine_top_k(T.queries_of(spark, d, split, vector), T.items(spark, d), K, 9)


@query(metrics_sql(rank_sql(QV.format(v="fused", s="validation")), REL))
def mean_fusion_validation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Mean-fusion cosine top-10 on validation and its recall, MRR and nDCG."""
    wanted = T.relevance(spark, d).join(T.queries_of(spark, d, "validation").select("query_id"), "query_id", "left_semi")
    return metrics.summary(metrics.per_query(_ranked(spark, d, "validation", "fused"), wanted, K), digits=9)


@query(f"SELECT query_id, rank, item_id, score FROM {rank_sql(QV.format(v='text_vector', s='validation'))}")
def text_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "validation", "text_vector")


@query(f"SELECT query_id, rank, item_id, score FROM {rank_sql(QV.format(v='fused', s='ood_test'))}")
def mean_fusion_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "ood_test", "fused")


@query(f"SELECT query_id, rank, item_id, score FROM {rank_sql(QV.format(v='fused', s='ood_test'), 3)}")
def cosine_by_expressions(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.cosine_expressions(T.queries_of(spark, d, "ood_test"), T.items(spark, d), 3, 9)


def random_sql(queries: str, key: str) -> str:
    """(query_id, rank, item_id): the first items of each query's keyed permutation."""
    images = f"SELECT query_id, u.x AS x, n, {permutation.image_sql('u.x', key, SEED)} AS number FROM {queries} q, {permutation.sides_sql('items')} s, unnest(range(0, {K} + a * b - n)) AS u(x)"
    first = f"SELECT query_id, number, row_number() OVER (PARTITION BY query_id ORDER BY x) AS rank FROM ({images}) WHERE number < n QUALIFY rank <= {K}"
    return f"(SELECT query_id, rank, item_id FROM ({first}) JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS number FROM items) USING (number))"


RANDOM = random_sql("(SELECT event_id AS query_id FROM ev WHERE split IN ('validation', 'ood_test'))", "query_id")
#: The first items of a random order of all items for each query.
SHUFFLED = f"(SELECT event_id AS query_id, item_id, row_number() OVER (PARTITION BY event_id ORDER BY sha256(concat_ws(':', '{SEED}', event_id, item_id)), item_id) AS rank FROM ev, items WHERE split IN ('validation', 'ood_test') QUALIFY rank <= {K})"


@query(f"SELECT query_id, rank, item_id FROM {RANDOM}")
def random_ranking(spark: SparkSession, d: str) -> DataFrame:
    q = T.events(spark, d).where("split in ('validation', 'ood_test')").select(F.col("event_id").alias("query_id"))
    return retrieval.random_top_k(q, T.items(spark, d), K, SEED)


RANKERS = ("random", "text_only", "mean_fusion", "ridge")


def fixed_ridge() -> ridge.Ridge:
    """The projection with fixed coefficients, for comparisons with SQL."""
    return ridge.Ridge(tuple(map(tuple, FIXED)), (0.0,) * T.DIM, 1)


def _three(spark: SparkSession, d: str, shuffled: bool = False) -> DataFrame:
    """Rankings of four rankers on validation and out-of-distribution events; the library is written once.

    ``shuffled``: the random ranker orders the whole library for each query.
    """
    e, items = keep(T.events(spark, d).where("split in ('validation', 'ood_test')").select("event_id", "text_vector", "fused"), "events"), retrieval.prepare(T.items(spark, d))
    by = lambda v: retrieval.cosine_top_k(e.select(F.col("event_id").alias("query_id"), v.alias("vector")), items, K, 9)
    fused = F.col("fused")
    random = (lambda q: retrieval.shuffled_top_k(q, items, K, SEED)) if shuffled else (lambda q: retrieval.random_top_k(q, T.items(spark, d), K, SEED))
    rankers = {"random": random, "text_only": lambda q: by(F.col("text_vector")), "mean_fusion": lambda q: by(fused), "ridge": lambda q: by(fixed_ridge().predict(fused))}
    return retrieval.all_rankers(e.select(F.col("event_id").alias("query_id")), rankers)


def _judged(spark: SparkSession, d: str, rankings: DataFrame) -> DataFrame:
    """Metrics by ranker and split of all validation and out-of-distribution events."""
    e = T.events(spark, d).where("split in ('validation', 'ood_test')")
    wanted = e.select(F.col("event_id").alias("query_id"), F.col("target_item_id").alias("item_id"), "split")
    cells = spark.createDataFrame([(r,) for r in RANKERS], "ranker string")
    return metrics.summary(metrics.per_query(rankings, wanted, K, ("ranker", "split"), cells), ("ranker", "split"), 9)


_PROJECT = "list_transform(range(1, 17), lambda r: list_sum(list_transform(range(1, 17), lambda c: ((((r - 1) * 7 + (c - 1) * 3) % 11) - 5) / 10.0::DOUBLE * {v}[c])))"
PROJECT = _PROJECT.format(v="fused")


def projected_sql(table: str, keys: str, vector: str = "fused") -> str:
    """(keys, vector): the unit vector of the fixed projection."""
    return f"(SELECT {keys}, {T.unit_sql('f')} AS vector FROM (SELECT {keys}, {_PROJECT.format(v=vector)} AS f FROM {table}))"


_BOTH = "(SELECT event_id AS query_id, {v} AS vector FROM ev WHERE split IN ('validation', 'ood_test'))"
_RIDGE = projected_sql("(SELECT event_id AS query_id, fused FROM ev WHERE split IN ('validation', 'ood_test'))", "query_id")
_OTHERS = f"SELECT 'text_only', query_id, rank, item_id FROM {rank_sql(_BOTH.format(v='text_vector'))} UNION ALL SELECT 'mean_fusion', query_id, rank, item_id FROM {rank_sql(_BOTH.format(v='fused'))} UNION ALL SELECT 'ridge', query_id, rank, item_id FROM {rank_sql(_RIDGE)}"
_JOINED = "(SELECT x.*, ev.split FROM (SELECT 'random' AS ranker, query_id, rank, item_id FROM {random} UNION ALL {others}) x JOIN ev ON ev.event_id = x.query_id)"
THREE = _JOINED.format(random=RANDOM, others=_OTHERS)
THREE_SHUFFLED = _JOINED.format(random=SHUFFLED, others=_OTHERS)
_ASKED = "(SELECT ranker, split, event_id AS query_id FROM ev, (VALUES ('random'), ('text_only'), ('mean_fusion'), ('ridge')) AS r(ranker) WHERE split IN ('validation', 'ood_test'))"
_METRICS = metrics_sql(THREE, REL, "ranker, split", _ASKED)


@query(_METRICS)
def ranker_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, _three(spark, d))


@query(f"SELECT * FROM ({_METRICS}) WHERE ranker = 'mean_fusion' AND split = 'ood_test'")
def metrics_of_one_cell(spark: SparkSession, d: str) -> DataFrame:
    return validation.one_cell(keep(ranker_metrics(spark, d), "metrics"), ranker="mean_fusion", split="ood_test")


#: Rankings from which some queries of one ranker, and one ranker as a whole, are missing.
_GAPS = f"(SELECT * FROM {THREE} WHERE ranker <> 'random' AND NOT (ranker = 'ridge' AND query_id LIKE '%3'))"


@query(metrics_sql(_GAPS, REL, "ranker, split", _ASKED))
def metrics_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """A query that a ranker doesn't rank counts as 0 there."""
    return _judged(spark, d, _three(spark, d).where("ranker <> 'random' and not (ranker = 'ridge' and query_id like '%3')"))


@query(f"SELECT split, ranker, mrr, recall_k FROM ({_METRICS}) QUALIFY row_number() OVER (PARTITION BY split ORDER BY mrr DESC, recall_k DESC, ranker) = 1")
def best_ranker(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.first_by(ranker_metrics(spark, d), ["split"], F.col("mrr").desc(), F.col("recall_k").desc(), "ranker").select("split", "ranker", "mrr", "recall_k")


@query(f"SELECT count(*) AS cells, count(*) FILTER (WHERE NOT (recall_1 BETWEEN 0 AND 1) OR NOT (recall_k BETWEEN 0 AND 1) OR recall_k < recall_1) AS bad FROM ({_METRICS})")
def metric_sanity(spark: SparkSession, d: str) -> DataFrame:
    table = ranker_metrics(spark, d)
    return table.agg(F.count("*").alias("cells")).join(metrics.sane(table).agg(F.count("*").alias("bad")))


@query("SELECT ranker, split, n FROM (VALUES ('memory', 'validation', 0::BIGINT), ('memory', 'ood_test', 0), ('text_only', 'validation', 1)) AS x(ranker, split, n)")
def grid_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a grid that names a ranker which wasn't run, and one with another event count than its split's."""
    short = F.when((F.col("ranker") == "text_only") & (F.col("split") == "validation"), F.col("n_events") - 1).otherwise(F.col("n_events"))
    return metrics.grid_gaps(ranker_metrics(spark, d).withColumn("n_events", short), {"ranker": [*RANKERS, "memory"], "split": ["validation", "ood_test"]}, ("split",))


@query("SELECT a.vec_id AS vec_id, b.vec_id AS other_id, round(list_cosine_similarity(a.e, b.e), 9) AS cosine, round(list_inner_product(a.e, b.e), 6) AS dot, round(sqrt(list_inner_product(a.e, a.e)), 6) AS norm FROM vecs a JOIN vecs b ON b.vec_id = a.vec_id + 1")
def cosine_of_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast(V.DOUBLES).alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("a").alias("b")), "vec_id")
    return pairs.select("vec_id", "other_id", F.round(V.cosine(F.col("a"), F.col("b")), 9).alias("cosine"), F.round(V.dot(F.col("a"), F.col("b")), 6).alias("dot"), F.round(V.norm(F.col("a")), 6).alias("norm"))


@query(f"""WITH gaps AS (SELECT event_id, CASE WHEN vec_id % 3 <> 0 THEN text_vector END AS t, CASE WHEN vec_id % 4 <> 0 THEN image_vector END AS i, CASE WHEN vec_id % 7 <> 0 THEN audio_vector END AS a FROM ev),
    s AS (SELECT event_id, list_filter([t, i, a], lambda x: x IS NOT NULL) AS vs FROM gaps),
    m AS (SELECT event_id, len(vs) AS n, list_transform(range(1, 17), lambda k: coalesce(list_sum(list_transform(vs, lambda v: v[k])), 0) / greatest(len(vs), 1)) AS f FROM s)
    SELECT event_id, n, CASE WHEN n > 0 THEN list_transform({T.unit_sql('f')}, lambda x: round(x, 9) + 0.0) END AS fused FROM m""")
def fusion_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Mean fusion of the modalities that are there."""
    e = T.events(spark, d)
    gap = lambda c, n: F.when(F.col("vec_id") % n != 0, F.col(c))
    m = [gap("text_vector", 3), gap("image_vector", 4), gap("audio_vector", 7)]
    return e.select("event_id", F.size(F.array_compact(F.array(*m))).cast("long").alias("n"), V.rounded(V.fuse(m)).alias("fused"))


_SWEEP = " UNION ALL ".join(
    f"SELECT '{name}' AS kept, * FROM ({metrics_sql(rank_sql(f'(SELECT event_id AS query_id, {T.unit_sql(chr(102))} AS vector FROM (SELECT event_id, list_transform(range(1, 17), lambda k: ({expr}) / {n}.0) AS f FROM ev WHERE split = {chr(39)}validation{chr(39)}))'), REL)})"
    for name, expr, n in (("text", "text_vector[k]", 1), ("text,image", "text_vector[k] + image_vector[k]", 2), ("text,image,audio", "text_vector[k] + image_vector[k] + audio_vector[k]", 3))
)


@query(_SWEEP)
def missing_modality_sweep(spark: SparkSession, d: str) -> DataFrame:
    out = None
    e, items = T.split_of(spark, d, "validation"), retrieval.prepare(T.items(spark, d))
    wanted = e.select(F.col("event_id").alias("query_id"), F.col("target_item_id").alias("item_id"))
    for kept in (["text"], ["text", "image"], ["text", "image", "audio"]):
        q = e.select(F.col("event_id").alias("query_id"), V.fuse([F.col(f"{m}_vector") for m in V.select_modalities(kept)]).alias("vector"))
        one = metrics.summary(metrics.per_query(retrieval.cosine_top_k(q, items, K, 9), wanted, K), digits=9).withColumn("kept", F.lit(",".join(kept)))
        out = one if out is None else out.unionByName(one)
    return out


NOISE = (0.0, 0.1, 0.2, 0.3, 0.4)
_NOISY = f"""WITH nz AS (SELECT event_id || '|' || level AS query_id, level, target_item_id AS item_id, list_transform(range(1, 17), lambda k: fused[k] + level * (CAST('0x' || substr(sha256(concat_ws(':', event_id, k - 1)), 1, 8) AS BIGINT)::DOUBLE / 4294967295.0::DOUBLE * 2 - 1)) AS f
    FROM ev, (VALUES {', '.join(f"({x}::DOUBLE)" for x in NOISE)}) AS l(level) WHERE split = 'validation'), nq AS (SELECT query_id, {T.unit_sql('f')} AS vector FROM nz), nr AS (SELECT r.*, level FROM {rank_sql('nq')} r JOIN nz USING (query_id))"""


@query(f"{_NOISY} {metrics_sql('nr', '(SELECT query_id, item_id FROM nz)', 'level')}")
def noise_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Mean fusion on validation queries with growing noise."""
    e = T.split_of(spark, d, "validation").withColumn("level", F.explode(F.array(*map(F.lit, NOISE)))).withColumn("query_id", F.concat_ws("|", "event_id", F.col("level").cast("string")))
    q = e.select("query_id", V.with_noise(F.col("fused"), F.col("level"), F.col("event_id")).alias("vector"))
    rankings = retrieval.cosine_top_k(q, T.items(spark, d), K, 9).join(e.select("query_id", "level"), "query_id")
    per = metrics.per_query(rankings, e.select("query_id", F.col("target_item_id").alias("item_id"), "level"), K, ("level",))
    return metrics.summary(per, ("level",), 9)


@query("""WITH z AS (SELECT list_concat([1.0::DOUBLE], list_concat(ev.fused, items.item_vector)) AS z FROM ev JOIN items ON items.item_id = ev.target_item_id WHERE split = 'train')
    SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(sum(z[i] * z[j]), 6) + 0.0 AS value FROM z, unnest(range(1, 34)) AS a(i), unnest(range(1, 34)) AS b(j) GROUP BY i, j""")
def ridge_gram(spark: SparkSession, d: str) -> DataFrame:
    """Gram sums of the ridge fit over training events and their items."""
    return ridge.gram(_training(spark, d), "fused", "item_vector").select("i", "j", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def _training(spark: SparkSession, d: str) -> DataFrame:
    items = T.items(spark, d).select(F.col("item_id").alias("target_item_id"), "item_vector")
    return T.split_of(spark, d, "train").join(items, "target_item_id")


@query(f"WITH pq AS (SELECT * FROM {projected_sql(QV.format(v='fused', s='validation').replace('vector', 'fused'), 'query_id')}) SELECT query_id, rank, item_id, score FROM {rank_sql('pq')}")
def projected_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Ranking by a projection with fixed coefficients."""
    q = T.queries_of(spark, d, "validation").withColumn("vector", fixed_ridge().predict(F.col("vector")))
    return retrieval.cosine_top_k(q, T.items(spark, d), K, 9)


def fitted_sql(train: str, name: str = "w") -> str:
    """CTEs up to ``name``_fit (seed, c: 16 rows of 16, b): a ridge for each seed of ``train`` (seed, x, y), by elimination."""
    n = name
    return f"""{n}_mu AS (SELECT seed, count(*) AS n, list_transform(range(1, 17), lambda i: 0) AS z FROM {train} GROUP BY seed),
    {n}_e AS (SELECT seed, i, avg(x[i]) AS mx, avg(y[i]) AS my FROM {train}, unnest(range(1, 17)) AS r(i) GROUP BY seed, i),
    {n}_m AS (SELECT seed, list(mx ORDER BY i) AS mx, list(my ORDER BY i) AS my FROM {n}_e GROUP BY seed),
    {n}_g AS (SELECT seed, i, j, sum((x[i] - mx[i]) * (x[j] - mx[j])) + CASE WHEN i = j THEN 1 ELSE 0 END AS a, sum((x[i] - mx[i]) * (y[j] - my[j])) AS r FROM {train} JOIN {n}_m USING (seed), unnest(range(1, 17)) AS p(i), unnest(range(1, 17)) AS q(j) GROUP BY seed, i, j),
    {n}_rows AS (SELECT seed, i, list_concat(list(a ORDER BY j), list(r ORDER BY j)) AS v FROM {n}_g GROUP BY seed, i),
    {n}_s(seed, k, m) AS (SELECT seed, 1, list(v ORDER BY i) FROM {n}_rows GROUP BY seed UNION ALL
      SELECT seed, k + 1, list_transform(range(1, 17), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda x: x / m[k][k]) ELSE list_transform(range(1, 33), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END) FROM {n}_s WHERE k <= 16),
    {n}_c AS (SELECT seed, list_transform(range(1, 17), lambda o: list_transform(range(1, 17), lambda i: m[i][16 + o])) AS c FROM {n}_s WHERE k = 17),
    {n}_fit AS (SELECT seed, c, list_transform(range(1, 17), lambda o: my[o] - list_inner_product(c[o], mx)) AS b FROM {n}_c JOIN {n}_m USING (seed))"""


def predicted_sql(queries: str, fit: str, keys: str) -> str:
    """(keys, vector): unit predictions for ``queries`` (keys, seed, fused)."""
    return f"(SELECT {keys}, {T.unit_sql('f')} AS vector FROM (SELECT {keys}, list_transform(range(1, 17), lambda o: list_inner_product(c[o], fused) + b[o]) AS f FROM {queries} JOIN {fit} USING (seed)))"


TRAINING = "(SELECT 0 AS seed, ev.fused AS x, items.item_vector AS y FROM ev JOIN items ON items.item_id = ev.target_item_id WHERE split = 'train')"
_PREDICTED = predicted_sql("(SELECT event_id AS query_id, 0 AS seed, fused FROM ev WHERE split IN ('validation', 'ood_test'))", "w_fit", "query_id")


def rounded_metrics(sql: str, keys: str) -> str:
    return f"SELECT {keys}, n_events, round(recall_1, 6) AS recall_1, round(recall_k, 6) AS recall_k, round(mrr, 6) AS mrr, round(ndcg_k, 6) AS ndcg_k FROM ({sql})"


@query(f"WITH RECURSIVE tr AS (SELECT * FROM {TRAINING}), {fitted_sql('tr')} SELECT CAST(o AS INTEGER) AS output, round(b[o], 6) + 0.0 AS intercept, list_transform(c[o], lambda x: round(x, 6) + 0.0) AS coefficients FROM w_fit, unnest(range(1, 17)) AS r(o)")
def ridge_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """The ridge fitted on training events."""
    model = ridge.fit(_training(spark, d), "fused", "item_vector", T.DIM)
    rows = [(k + 1, round(b, 6) + 0.0, [round(x, 6) + 0.0 for x in c]) for k, (b, c) in enumerate(zip(model.intercept, model.coefficients, strict=True))]
    return spark.createDataFrame(rows, "output int, intercept double, coefficients array<double>")


@query(f"WITH RECURSIVE tr AS (SELECT * FROM {TRAINING}), {fitted_sql('tr')}, pq AS (SELECT * FROM {_PREDICTED}), rk AS (SELECT x.*, split FROM {rank_sql('pq')} x JOIN ev ON ev.event_id = x.query_id) {rounded_metrics(metrics_sql('rk', REL, 'split'), 'split')}")
def ridge_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The fitted ridge ranker on validation and out-of-distribution events."""
    model = ridge.fit(_training(spark, d), "fused", "item_vector", T.DIM)
    e = T.events(spark, d).where("split in ('validation', 'ood_test')")
    q = e.select(F.col("event_id").alias("query_id"), model.predict(F.col("fused")).alias("vector"))
    wanted = e.select(F.col("event_id").alias("query_id"), F.col("target_item_id").alias("item_id"), "split")
    rankings = retrieval.cosine_top_k(q, T.items(spark, d), K, 9)
    return metrics.summary(metrics.per_query(rankings, wanted, K, ("split",)), ("split",), 6)


@query("SELECT item_id, family_id, list_transform(item_vector, lambda x: round(x, 9) + 0.0) AS item_vector FROM items")
def item_library(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.library(T.items(spark, d)).withColumn("item_vector", V.rounded(F.col("item_vector")))


_AGE = "(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(m.updated_at)) / 86400e6"


def _memory_sql(rate: float | None, k: int) -> str:
    w = f"greatest(exp(-{rate} * {_AGE}), 2.2250738585072014e-308)" if rate is not None else "1.0::DOUBLE"
    return f"SELECT query_id, memory_id, item_id, rank, score FROM (SELECT q.event_id AS query_id, m.memory_id, m.item_id, round(greatest(0, least(1, list_inner_product(q.fused, m.context_vector))) * m.strength * {w}, 9) AS score, row_number() OVER (PARTITION BY q.event_id ORDER BY score DESC, m.item_id, m.memory_id) AS rank FROM ev q, mem m WHERE q.split = 'validation') WHERE rank <= {k}"


def _memory_top(spark: SparkSession, d: str, rate: float | None) -> DataFrame:
    q = T.queries_of(spark, d, "validation").withColumn("as_of", F.lit(T.AS_OF).cast("timestamp"))
    return M.top_memories(q, T.memory(spark, d), 5, rate, 9).select("query_id", "memory_id", "item_id", "rank", "score")


@query(_memory_sql(0.01, 5))
def memory_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _memory_top(spark, d, 0.01)


@query(_memory_sql(None, 5))
def memory_ranking_without_decay(spark: SparkSession, d: str) -> DataFrame:
    return _memory_top(spark, d, None)


@query("SELECT memory_id, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(updated_at)) / 86400e6, 9) AS age, round(greatest(exp(-0.01 * ((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(updated_at)) / 86400e6)), 2.2250738585072014e-308), 9) AS weight FROM mem")
def memory_decay(spark: SparkSession, d: str) -> DataFrame:
    age = S.age_days(F.lit(T.AS_OF).cast("timestamp"), F.col("updated_at"))
    return T.memory(spark, d).select("memory_id", F.round(age, 9).alias("age"), F.round(S.decay(age), 9).alias("weight"))


def _cells(spark: SparkSession, d: str, split: str, cells: list[dict], k: int = K, model: ridge.Ridge | None = None) -> DataFrame:
    q = T.queries_of(spark, d, split).withColumn("projected", (model or fixed_ridge()).predict(F.col("vector"))).withColumn("as_of", F.lit(T.AS_OF).cast("timestamp"))
    return retrieval.hybrid_top_k(q, T.items(spark, d), T.memory(spark, d), cells, k, 9)


def _scores_sql(queries: str, memory: str = "mem", age: str = _AGE, projected: str | None = None) -> str:
    """(query_id, item_id, lib, m0: memory without decay, m1: with) of every query and item; the library meets the projection."""
    return f"""pj AS (SELECT * FROM {projected or projected_sql(queries, 'query_id', 'vector')}),
    lib AS (SELECT q.query_id, i.item_id, greatest(0, least(1, list_inner_product(q.vector, i.item_vector))) AS lib FROM pj q, items i),
    rec AS (SELECT q.query_id, m.item_id, max(greatest(0, least(1, list_inner_product(q.vector, m.context_vector))) * m.strength) AS m0, max(greatest(0, least(1, list_inner_product(q.vector, m.context_vector))) * m.strength * greatest(exp(-0.01 * {age}), 2.2250738585072014e-308)) AS m1 FROM {queries} q, {memory} m WHERE m.active GROUP BY 1, 2),
    base AS (SELECT lib.query_id, lib.item_id, lib, coalesce(m0, 0) AS m0, coalesce(m1, 0) AS m1 FROM lib LEFT JOIN rec USING (query_id, item_id))"""


_VQ = QV.format(v="fused", s="validation")


@query(f"WITH {_scores_sql(_VQ)} SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank, score, round(lib, 9) AS library_score, round(m1, 9) AS memory_score FROM (SELECT *, round(greatest(0, least(1, 0.5 * lib + 0.5 * m1)), 9) AS score FROM base) QUALIFY rank <= 10")
def hybrid_ranking(spark: SparkSession, d: str) -> DataFrame:
    out = _cells(spark, d, "validation", [{"cell": "half", "alpha": 0.5, "rate": 0.01, "days": 0}])
    return out.select("query_id", "item_id", "rank", "score", F.round("library_score", 9).alias("library_score"), F.round("memory_score", 9).alias("memory_score"))


def _alpha_sql(projected: str | None = None) -> str:
    """CTEs up to r: rankings of validation events with each weight."""
    return f"""{_scores_sql(_VQ, projected=projected)}, alphas AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE)' for a in ALPHAS)}) AS x(alpha)),
    r AS (SELECT alpha, query_id, item_id, row_number() OVER (PARTITION BY alpha, query_id ORDER BY round(greatest(0, least(1, alpha * lib + (1 - alpha) * m1)), 9) DESC, item_id) AS rank FROM base, alphas QUALIFY rank <= 10)"""


_ALPHA = f"WITH {_alpha_sql()}"


def _alphas(spark: SparkSession, d: str, model: ridge.Ridge | None = None) -> DataFrame:
    cells = [{"cell": str(a), "alpha": a, "rate": 0.01, "days": 0} for a in ALPHAS]
    wanted = T.split_of(spark, d, "validation").select(F.col("event_id").alias("query_id"), F.col("target_item_id").alias("item_id"))
    per = metrics.per_query(_cells(spark, d, "validation", cells, model=model), wanted, K, ("cell",), spark.createDataFrame([(c["cell"],) for c in cells], "cell string"))
    return metrics.summary(per, ("cell",), 9).withColumn("alpha", F.col("cell").cast("double"))


@query(f"{_ALPHA} SELECT alpha, mrr FROM ({metrics_sql('r', REL, 'alpha')})")
def alpha_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _alphas(spark, d).select("alpha", "mrr")


@query(f"{_ALPHA} SELECT alpha, mrr FROM ({metrics_sql('r', REL, 'alpha')}) ORDER BY mrr DESC, alpha DESC LIMIT 1")
def selected_alpha(spark: SparkSession, d: str) -> DataFrame:
    """The best weight by validation MRR alone, the larger one of equals."""
    return _alphas(spark, d).groupBy().agg(F.max(F.struct("mrr", "alpha")).alias("b")).select("b.alpha", "b.mrr")


ALPHA = 0.5


def _grid_cells(weight: float = ALPHA) -> list[dict]:
    alpha = {"ridge_only": 1.0, "memory_only": 0.0, "hybrid_no_decay": weight, "hybrid": weight}
    return [{"cell": f"{s}|{d}", "alpha": alpha[s], "rate": None if s in ("ridge_only", "hybrid_no_decay") else 0.01, "days": d} for s, d in GRID]


def _grid(spark: SparkSession, d: str, model: ridge.Ridge | None = None, weight: float = ALPHA) -> DataFrame:
    q = T.view_queries(spark, d).select("query_id", "vector", (model or fixed_ridge()).predict(F.col("vector")).alias("projected"), F.lit(T.AS_OF).cast("timestamp").alias("as_of"))
    out = retrieval.hybrid_top_k(q, T.items(spark, d), T.memory(spark, d), _grid_cells(weight), K, 9)
    parts = F.split("cell", r"\|")
    return out.select(parts[0].alias("system"), parts[1].cast("int").alias("day"), "query_id", "rank", "item_id")


_GRID_CELLS = ", ".join(f"('{c['cell'].split('|')[0]}', {c['days']}, {c['alpha']}::DOUBLE, {'NULL' if c['rate'] is None else 0.01}::DOUBLE)" for c in _grid_cells())
def _grid_sql(projected: str, cells: str = f"SELECT * FROM (VALUES {_GRID_CELLS}) AS x(system, day, alpha, rate)") -> str:
    """CTEs up to g: rankings of the views in each cell."""
    return f"""cells AS ({cells}),
    sim AS (SELECT q.query_id, m.item_id, greatest(0, least(1, list_inner_product(q.vector, m.context_vector))) * m.strength AS s, {_AGE} AS age FROM vq q, mem m),
    rec AS (SELECT system, day, query_id, item_id, max(s * CASE WHEN rate IS NULL THEN 1 ELSE greatest(exp(-rate * (age + day)), 2.2250738585072014e-308) END) AS m FROM sim, cells WHERE alpha < 1 GROUP BY ALL),
    pj AS (SELECT * FROM {projected}),
    lib AS (SELECT q.query_id, i.item_id, greatest(0, least(1, list_inner_product(q.vector, i.item_vector))) AS lib FROM pj q, items i),
    r AS (SELECT c.system, c.day, lib.query_id, lib.item_id, row_number() OVER (PARTITION BY c.system, c.day, lib.query_id ORDER BY round(greatest(0, least(1, alpha * lib + (1 - alpha) * coalesce(m, 0))), 9) DESC, lib.item_id) AS rank
      FROM lib CROSS JOIN cells c LEFT JOIN rec USING (system, day, query_id, item_id) QUALIFY rank <= 10),
    g AS (SELECT r.*, vq.tier FROM r JOIN vq USING (query_id))"""


_GRID_SQL = f"WITH {_grid_sql(projected_sql('vq', 'query_id', 'vector'))}"
_VREL = "(SELECT query_id, item_id FROM vq)"


_GRID_ASKED = f"(SELECT system, day, tier, query_id FROM vq, (VALUES {', '.join(f'({chr(39)}{s}{chr(39)}, {day})' for s, day in GRID)}) AS c(system, day))"
_GRID_METRICS = metrics_sql("g", _VREL, "system, tier, day", _GRID_ASKED)


@query(f"{_GRID_SQL} {_GRID_METRICS}")
def ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    """Four systems on three tiers and five days."""
    views = T.view_queries(spark, d).select("query_id", "item_id", "tier")
    cells = spark.createDataFrame(GRID, "system string, day int")
    return metrics.summary(metrics.per_query(_grid(spark, d), views, K, ("system", "tier", "day"), cells), ("system", "tier", "day"), 9)


@query(f"""{_GRID_SQL} SELECT tier, day, count(*) AS n_rows, coalesce(bool_and(a.item_id = b.item_id), true) AS same FROM (SELECT * FROM g WHERE system = 'hybrid_no_decay') a JOIN (SELECT * FROM g WHERE system = 'ridge_only') b USING (tier, day, query_id, rank) GROUP BY tier, day""")
def ablation_equality(spark: SparkSession, d: str) -> DataFrame:
    """Whether two systems' rankings are equal in each cell."""
    rankings = _grid(spark, d).join(T.view_queries(spark, d).select("query_id", "tier"), "query_id").where("system in ('hybrid_no_decay', 'ridge_only')")
    wide = rankings.groupBy("tier", "day", "query_id", "rank").pivot("system", ["hybrid_no_decay", "ridge_only"]).agg(F.first("item_id")).where("hybrid_no_decay is not null and ridge_only is not null")
    return wide.groupBy("tier", "day").agg(F.count("*").alias("n_rows"), F.bool_and(F.col("hybrid_no_decay") == F.col("ridge_only")).alias("same"))


@query(f"""{_GRID_SQL}, mm AS ({_GRID_METRICS}) SELECT tier, day, max(mrr) FILTER (WHERE system = 'hybrid') AS hybrid, max(mrr) FILTER (WHERE system = 'ridge_only') AS ridge_only, max(mrr) FILTER (WHERE system = 'hybrid') = max(mrr) FILTER (WHERE system = 'ridge_only') AS equal, bool_or(mrr > 0) FILTER (WHERE system = 'memory_only') AS memory_finds_any FROM mm GROUP BY tier, day""")
def ablation_mrr(spark: SparkSession, d: str) -> DataFrame:
    """MRR of two systems cell by cell, and whether the memory alone finds any target."""
    of = lambda s: F.max(F.when(F.col("system") == s, F.col("mrr")))
    each = ablation_grid(spark, d).groupBy("tier", "day").agg(of("hybrid").alias("hybrid"), of("ridge_only").alias("ridge_only"), F.bool_or(F.when(F.col("system") == "memory_only", F.col("mrr") > 0)).alias("memory_finds_any"))
    return each.withColumn("equal", F.col("hybrid") == F.col("ridge_only"))


def _fitted(queries: str) -> str:
    """(query_id, vector): unit predictions of the fitted ridge for (query_id, vector)."""
    return predicted_sql(f"(SELECT query_id, 0 AS seed, vector AS fused FROM {queries})", "w_fit", "query_id")


_FIT = f"tr AS (SELECT * FROM {TRAINING}), {fitted_sql('tr')}"
_FITTED_ALPHA = f"{_FIT}, {_alpha_sql(_fitted(_VQ))}"
_BEST = f"sel AS (WITH {_alpha_sql(_fitted(_VQ))} SELECT alpha, mrr FROM ({metrics_sql('r', REL, 'alpha')}) ORDER BY mrr DESC, alpha DESC LIMIT 1)"
_SELECTED_CELLS = f"SELECT system, day, CASE WHEN system IN ('hybrid', 'hybrid_no_decay') THEN (SELECT alpha FROM sel) ELSE alpha END AS alpha, rate FROM (VALUES {_GRID_CELLS}) AS x(system, day, alpha, rate)"
_CHAIN = f"WITH RECURSIVE {_FIT}, {_BEST}, {_grid_sql(_fitted('vq'), _SELECTED_CELLS)}"


def fitted_chain(spark: SparkSession, d: str) -> tuple[ridge.Ridge, float]:
    """The ridge fitted on training events, and the weight that ranks validation events best with it."""
    model = ridge.fit(_training(spark, d), "fused", "item_vector", T.DIM)
    best = _alphas(spark, d, model).groupBy().agg(F.max(F.struct("mrr", "alpha")).alias("b")).select("b.alpha").first()
    return model, ALPHA if best.alpha is None else best.alpha


@query(f"WITH RECURSIVE {_FITTED_ALPHA} SELECT alpha, mrr FROM ({metrics_sql('r', REL, 'alpha')})")
def fitted_alpha_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Validation MRR of each weight, with the fitted ridge on the library's side."""
    return _alphas(spark, d, ridge.fit(_training(spark, d), "fused", "item_vector", T.DIM)).select("alpha", "mrr")


@query(f"{_CHAIN} SELECT m.*, (SELECT alpha FROM sel) AS alpha FROM ({_GRID_METRICS}) m")
def fitted_ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    """The ablation with the fitted ridge and the weight that validation selects: four systems, three tiers, five days."""
    model, weight = fitted_chain(spark, d)
    views = T.view_queries(spark, d).select("query_id", "item_id", "tier")
    per = metrics.per_query(_grid(spark, d, model, weight), views, K, ("system", "tier", "day"), spark.createDataFrame(GRID, "system string, day int"))
    return metrics.summary(per, ("system", "tier", "day"), 9).withColumn("alpha", F.lit(weight))


@query(f"""{_CHAIN}, mm AS ({_GRID_METRICS}) SELECT tier, day, max(mrr) FILTER (WHERE system = 'hybrid') AS hybrid, max(mrr) FILTER (WHERE system = 'ridge_only') AS ridge_only, round(max(mrr) FILTER (WHERE system = 'hybrid') - max(mrr) FILTER (WHERE system = 'ridge_only'), 9) + 0.0 AS gain, bool_or(mrr > 0) FILTER (WHERE system = 'memory_only') AS memory_finds_any FROM mm GROUP BY tier, day""")
def fitted_ablation_mrr(spark: SparkSession, d: str) -> DataFrame:
    """What the selected hybrid gains over the fitted ridge alone, cell by cell."""
    of = lambda s: F.max(F.when(F.col("system") == s, F.col("mrr")))
    each = fitted_ablation_grid(spark, d).groupBy("tier", "day").agg(of("hybrid").alias("hybrid"), of("ridge_only").alias("ridge_only"), F.bool_or(F.when(F.col("system") == "memory_only", F.col("mrr") > 0)).alias("memory_finds_any"))
    return each.withColumn("gain", F.round(F.col("hybrid") - F.col("ridge_only"), 9) + F.lit(0.0))


@query("SELECT rank, round(1.0::DOUBLE / rank, 9) AS rr, round(1.0::DOUBLE / log2(rank + 1), 9) AS gain, 'memory::' || event_id AS memory_id, 'latent-' || event_id || '::mild' AS observed_id, 'mild' || '_minus_' || 'severe' AS contrast FROM (SELECT event_id, CAST(vec_id % 10 + 1 AS INTEGER) AS rank FROM ev)")
def gains_and_ids(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).select("event_id", (F.col("vec_id") % 10 + 1).cast("int").alias("rank"))
    return e.select("rank", F.round(S.reciprocal_rank(F.col("rank")), 9).alias("rr"), F.round(S.log2_gain(F.col("rank")), 9).alias("gain"), S.memory_id(F.col("event_id")).alias("memory_id"), S.observed_id(S.latent_id(F.col("event_id")), F.lit("mild")).alias("observed_id"), S.contrast_name(F.lit("mild"), F.lit("severe")).alias("contrast"))


@query(f"SELECT event_id, list_transform({PROJECT}, lambda x: round(x, 9) + 0.0) AS projected FROM ev")
def matrix_times_vector(spark: SparkSession, d: str) -> DataFrame:
    return T.events(spark, d).select("event_id", V.rounded(V.apply_matrix(FIXED, F.col("fused"))).alias("projected"))
