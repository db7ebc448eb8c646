"""Vector search, retrieval prompts, places, series and generators. embeddings and documents play reports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.numeric import pretty_bytes, rint_int
from tidemark.functions.timeseries import time_bucket
from tidemark.functions.vector import nearest, parse_vector
from tidemark.operators.joins import validate
from tidemark.operators.vector_index import VectorIndex
from tidemark.plans.registry import Tables, query, r4, r8
from tidemark.plans.wells import PLACES, places, point
from tidemark.retrieval.models import EchoChat, HashingEmbedder, Patient, Vectorizer, answer, chunk_texts, embed, search
from tidemark.session import new_path, prepare
from tidemark.sources import generators
from tidemark.sources.files import each_of, pg_array, time_series
from tidemark.streaming.rollup import bucket_stream, write_closed

MODEL = HashingEmbedder(64)
#: A table of named colours as vectors.
COLOURS = [
    (1, "Red color vector", "[1.0, 0.0, 0.0]"),
    (2, "Green color vector", "[0.0, 1.0, 0.0]"),
    (3, "Blue color vector", "[0.0, 0.0, 1.0]"),
    (4, "Yellow color vector", "[1.0, 1.0, 0.0]"),
    (5, "Magenta color vector", "[1.0, 0.0, 1.0]"),
    (6, "Cyan color vector", "[0.0, 1.0, 1.0]"),
    (7, "White color vector", "[1.0, 1.0, 1.0]"),
    (8, "Black color vector", "[0.0, 0.0, 0.0]"),
    (9, "Light gray color vector", "[0.5, 0.5, 0.5]"),
    (10, "Orange color vector", "[1.0, 0.5, 0.0]"),
]
COLOUR_ROWS = ", ".join(f"({k}, '{name}', {vector}::DOUBLE[])" for k, name, vector in COLOURS)


def colours(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(COLOURS, "id int, description string, vector string").select("id", "description", parse_vector(F.col("vector")).alias("embedding"))


query("ai_vec_list", "SELECT vec_id, label, len(embedding) AS d FROM embeddings")(lambda t: t.embeddings.select("vec_id", "label", F.size("embedding").cast("long").alias("d")))
VEC = "SELECT vec_id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = {}) AS DOUBLE[])), 6) AS distance FROM embeddings{} ORDER BY list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = {}) AS DOUBLE[])), vec_id LIMIT {}"


def _top(t: Tables, vec_id, k: int, rows: DataFrame | None = None) -> DataFrame:
    one = t.embeddings.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("query")).limit(1)
    both = (t.embeddings if rows is None else rows).crossJoin(F.broadcast(one))
    return nearest(both, "embedding", F.col("query"), k, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


FIRST = "(SELECT min(vec_id) FROM embeddings)"
query("ai_vec_topk", VEC.format(FIRST, "", FIRST, 5))(lambda t: _top(t, t.embeddings.agg(F.min("vec_id")).scalar(), 5))
query("ai_vec_topk_sub", VEC.format("3", " WHERE label IN (1, 2, 3)", "3", 10))(lambda t: _top(t, F.lit(3), 10, t.embeddings.where(F.col("label").isin(1, 2, 3))))


@query("ai_vec_index", VEC.format(FIRST, "", FIRST, 5))
def indexed(t: Tables) -> DataFrame:
    """The same rows through the index, which reads only cells that may hold them."""
    index = VectorIndex.build(t.embeddings, new_path(t.spark, "vector-index"), "vec_id", "embedding")
    one = t.embeddings.orderBy("vec_id").select("embedding").first()["embedding"]
    return index.search(one, 5).select("vec_id", F.round("distance", 6).alias("distance"))


@query("ai_vec_index_filtered", VEC.format("3", " WHERE label IN (1, 2, 3)", "3", 10))
def indexed_filtered(t: Tables) -> DataFrame:
    """A third of the rows inserted later and the index opened anew; cells without the labels are not read."""
    path = new_path(t.spark, "vector-index")
    late = F.col("vec_id") % 3 == 0
    index = VectorIndex.build(t.embeddings.where(~late), path, "vec_id", "embedding", label="label")
    index.insert(t.embeddings.where(late))
    one = t.embeddings.where("vec_id = 3").select("embedding").first()["embedding"]
    return VectorIndex.open(t.spark, path).search(one, 10, labels=[1, 2, 3]).select("vec_id", F.round("distance", 6).alias("distance"))


@query("ai_vec_recall", "SELECT count(*) AS queries, true AS found_nine_in_ten FROM embeddings WHERE vec_id % 50 = 0")
def recall(t: Tables) -> DataFrame:
    """Of the ten nearest rows of every fiftieth one, how many the cells give that sufficed for other queries."""
    index = VectorIndex.build(t.embeddings, new_path(t.spark, "vector-index"), "vec_id", "embedding")
    of = lambda k: t.embeddings.where(F.col("vec_id") % 50 == k).select(F.col("vec_id").alias("q"), "embedding")
    queries = of(0)
    probes = index.probes_for(of(1), "q", "embedding", 10, 0.97)
    few, whole = (index.search_many(queries, "q", "embedding", 10, p).select("query", "vec_id") for p in (probes, len(index.cells)))
    path = new_path(t.spark, "nearest-of-all")
    whole.write.parquet(path)  # all rows are looked at once
    whole = t.spark.read.parquet(path)
    hits, wanted = few.join(whole, ["query", "vec_id"]).agg(F.count("*")).scalar(), whole.agg(F.count("*")).scalar()
    return queries.agg(F.count("*").alias("queries"), (hits >= 0.9 * wanted).alias("found_nine_in_ten"))


@query("ai_vec_colours", f"SELECT id, description, round(list_cosine_distance(embedding, [1.0, 0.0, 0.0]::DOUBLE[]), 4) AS distance FROM (VALUES {COLOUR_ROWS}) v(id, description, embedding) WHERE id <> 8 ORDER BY list_cosine_distance(embedding, [1.0, 0.0, 0.0]::DOUBLE[]), id LIMIT 5")
def colour_search(t: Tables) -> DataFrame:
    """A zero vector has no distance and ranks last; ties go by id."""
    return nearest(colours(t), "embedding", parse_vector(F.lit("[1.0, 0.0, 0.0]")), 5, "id").select("id", "description", r4(F.col("distance")).alias("distance"))


def _vectorizer(t: Tables) -> tuple[Vectorizer, DataFrame]:
    v, source = Vectorizer(new_path(t.spark, "reports"), "doc_id", "text", MODEL, size=2000), t.documents.select("doc_id", "text")
    v.run(source.where("doc_id % 2 = 0"))
    return v, source


query("ai_status", "SELECT count(*) AS pending FROM documents WHERE doc_id % 2 <> 0 OR coalesce(text, '') = ''")(lambda t: (lambda v, s: v.pending(s).agg(F.count("*").alias("pending")))(*_vectorizer(t)))


EDITED = "(SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' addendum' ELSE text END AS text FROM documents WHERE lang IS NULL OR lang <> 'fr')"


def _edited(t: Tables) -> tuple[Vectorizer, DataFrame]:
    """Documents are embedded; then German ones get longer and French ones go."""
    v = Vectorizer(new_path(t.spark, "reports"), "doc_id", "text", MODEL, size=2000)
    v.run(t.documents.select("doc_id", "text"))
    later = t.documents.where("lang is null or lang <> 'fr'").select("doc_id", F.when(F.col("lang") == "de", F.concat("text", F.lit(" addendum"))).otherwise(F.col("text")).alias("text"))
    return v, later


@query("ai_vectorizer_pending", "SELECT change, count(*) AS n FROM (SELECT CASE WHEN coalesce(text, '') = '' AND coalesce(lang, '') <> 'fr' AND NOT coalesce(lang = 'de' AND text = '', false) THEN 'new' WHEN lang = 'fr' AND text <> '' THEN 'gone' WHEN lang = 'de' AND text <> '' THEN 'changed' WHEN lang = 'de' AND text = '' THEN 'new' END AS change FROM documents) WHERE change IS NOT NULL GROUP BY 1")
def vectorizer_pending(t: Tables) -> DataFrame:
    return (lambda v, s: v.changes(s).groupBy("change").agg(F.count("*").alias("n")))(*_edited(t))


@query("ai_vectorizer_changes", f"SELECT doc_id, length(text) AS chars FROM {EDITED} WHERE text <> ''")
def vectorizer_changes(t: Tables) -> DataFrame:
    v, later = _edited(t)
    v.run(later)
    return v.stored(later).groupBy("doc_id").agg(F.sum(F.char_length("chunk")).alias("chars"))


@query("ai_count")
def stored_chunks(t: Tables) -> DataFrame:
    v, source = _vectorizer(t)
    v.run(source)
    return v.stored(source).agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"))


query("ai_chunks", "SELECT doc_id, length(text) AS chars FROM documents WHERE text <> ''")(lambda t: chunk_texts(t.documents, "doc_id", "text", 800).groupBy("doc_id").agg(F.sum(F.char_length("chunk")).alias("chars")))


@query("ai_embed")
def embedded(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", embed(F.col("text"), MODEL).alias("embedding"))


query("ai_chat")(lambda t: t.spark.createDataFrame([(EchoChat().complete("You are terse.", "Say hello."),)], "content string"))


def _reports(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), "text", "lang", "source", embed(F.col("text"), MODEL).alias("embedding"))


@query("ai_semantic")
def semantic(t: Tables) -> DataFrame:
    return search(_reports(t), "charging fault", MODEL, 10).select("id", r4(F.col("distance")).alias("distance"))


@query("ai_rag")
def rag(t: Tables) -> DataFrame:
    found = search(_reports(t), "charging fault", MODEL, 10)
    return t.spark.createDataFrame([(answer(found, "text", ["distance", "id"], "Sum up the reports.", "charging fault", EchoChat()),)], "content string")


FOUND = "(SELECT vec_id, list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 3) AS DOUBLE[])) AS distance FROM embeddings WHERE label IN (1, 2, 3) ORDER BY distance, vec_id LIMIT 10)"


@query("ai_rag_context", f"SELECT 'Sum up.' || chr(10) || 'What is it?' || chr(10) || string_agg(coalesce(text, ''), chr(10) ORDER BY distance, vec_id) AS content FROM {FOUND} JOIN documents ON vec_id = doc_id")
def rag_context(t: Tables) -> DataFrame:
    """What a chat model is told: the texts of the ten nearest vectors of some labels, nearest first."""
    one = t.embeddings.where("vec_id = 3").select(F.col("embedding").alias("query")).limit(1)
    found = nearest(t.embeddings.where(F.col("label").isin(1, 2, 3)).crossJoin(F.broadcast(one)), "embedding", F.col("query"), 10, "vec_id")
    texts = found.join(t.documents, F.col("vec_id") == F.col("doc_id")).select("distance", "vec_id", "text")
    told = answer(texts, "text", ["distance", "vec_id"], "Sum up.", "What is it?", Patient(EchoChat()))
    return t.spark.createDataFrame([(told,)], "content string")


AWAY = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(31 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(31)) * pow(sin(radians(-102 - lon) / 2), 2))))"


@query("ai_geo", f"SELECT c_custkey, round({AWAY} / 1609.34, 4) AS miles FROM {PLACES} WHERE {AWAY} <= 50 * 1609.34")
def near(t: Tables) -> DataFrame:
    miles = geo.haversine(*point(), F.lit(-102.0), F.lit(31.0)) / geo.MILE
    return places(t).where(geo.within(*point(), -102, 31, 50 * geo.MILE)).select("c_custkey", r4(miles).alias("miles"))


#: Distances on the spheroid, spelled out: twenty rounds for the difference of longitudes on the auxiliary sphere.
SPHEROID = f"""
WITH RECURSIVE f AS (SELECT 1 / 298.257223563 AS f, 6378137.0 AS a, 6378137.0 * (1 - 1 / 298.257223563) AS b),
p AS (SELECT c_custkey, radians(-102 - lon) AS l, atan((1 - f) * tan(radians(lat))) AS u, atan((1 - f) * tan(radians(31))) AS v FROM {PLACES}, f),
w(c_custkey, l, u, v, x, k) AS (
  SELECT c_custkey, l, u, v, l, 0 FROM p
  UNION ALL
  SELECT c_custkey, l, u, v, l + (1 - k1) * f * al * (si + k1 * s * (m + k1 * c * (2 * m * m - 1))), k + 1 FROM (
    SELECT *, f / 16 * sq * (4 + f * (4 - 3 * sq)) AS k1 FROM (
      SELECT *, CASE WHEN sq > 0 THEN c - 2 * sin(u) * sin(v) / sq ELSE 0 END AS m FROM (
        SELECT *, 1 - al * al AS sq FROM (
          SELECT *, atan2(s, c) AS si, CASE WHEN s > 0 THEN cos(u) * cos(v) * sin(x) / s ELSE 0 END AS al FROM (
            SELECT *, sqrt(pow(cos(v) * sin(x), 2) + pow(cos(u) * sin(v) - sin(u) * cos(v) * cos(x), 2)) AS s, sin(u) * sin(v) + cos(u) * cos(v) * cos(x) AS c FROM w, f))))) WHERE k < 20
), e AS (
  SELECT c_custkey, b * (1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))) AS ba, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS bb, s, c, si, m FROM (
    SELECT *, sq * (a * a - b * b) / (b * b) AS q, CASE WHEN sq > 0 THEN c - 2 * sin(u) * sin(v) / sq ELSE 0 END AS m FROM (
      SELECT *, 1 - pow(CASE WHEN s > 0 THEN cos(u) * cos(v) * sin(x) / s ELSE 0 END, 2) AS sq, atan2(s, c) AS si FROM (
        SELECT *, sqrt(pow(cos(v) * sin(x), 2) + pow(cos(u) * sin(v) - sin(u) * cos(v) * cos(x), 2)) AS s, sin(u) * sin(v) + cos(u) * cos(v) * cos(x) AS c FROM w, f WHERE k = 20)))
), d AS (SELECT c_custkey, CASE WHEN s > 0 THEN ba * (si - bb * s * (m + bb / 4 * (c * (2 * m * m - 1) - bb / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))) ELSE 0 END AS metres FROM e)
SELECT c_custkey, round(metres / 1609.34, 4) AS miles FROM d WHERE metres <= 50 * 1609.34
"""


@query("ai_geo_spheroid", SPHEROID)
def near_on_spheroid(t: Tables) -> DataFrame:
    """As ai_geo, on the spheroid; nearest first."""
    prepare(t.spark)
    rows = geo.within_spheroid(places(t), *point(), -102, 31, 50 * geo.MILE)
    return rows.select("c_custkey", r4(F.col("metres") / geo.MILE).alias("miles")).orderBy("miles", "c_custkey")


@query("ai_geo_rag")
def geo_rag(t: Tables) -> DataFrame:
    """Reports of near places only, then the nearest by meaning, then the prompt."""
    close = near(t).select((F.col("c_custkey") % 20).cast("string").alias("place")).distinct()
    rows = _reports(t).withColumn("place", F.regexp_extract("source", r"(\d+)$", 1)).join(close, "place", "left_semi").where("lang = 'en'")
    found = search(rows, "charging fault", MODEL, 10)
    return t.spark.createDataFrame([(answer(found, "text", ["distance", "id"], "Sum up the reports.", "charging fault", EchoChat()),)], "content string")


DATED = "(SELECT doc_id, lang, source, TIMESTAMP '2024-01-01' + CAST(doc_id % 365 AS INTEGER) * INTERVAL 1 DAY AS made FROM documents)"


def dated(t: Tables) -> DataFrame:
    """Reports with a day each, from their numbers."""
    return _reports(t).withColumn("made", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(cast(id % 365 AS int))"))


@query("ai_geo_rag_rows", f"SELECT doc_id AS id FROM {DATED} WHERE lang = 'en' AND made >= TIMESTAMP '2024-03-01' AND made < TIMESTAMP '2024-07-01' AND doc_id % 1000 IN (SELECT c_custkey FROM {PLACES} WHERE {AWAY} <= 150 * 1609.34)")
def geo_rag_rows(t: Tables) -> DataFrame:
    """What a question about a place and a season is asked of: reports of a range of days, of the language, from stations
    near the place (a semi-join), before they are ranked by meaning."""
    close = places(t).where(geo.within(*point(), -102, 31, 150 * geo.MILE)).select(F.col("c_custkey").alias("station"))
    season = (F.col("made") >= F.lit(datetime(2024, 3, 1)).cast("timestamp_ntz")) & (F.col("made") < F.lit(datetime(2024, 7, 1)).cast("timestamp_ntz"))
    rows = dated(t).where(season & (F.col("lang") == "en")).withColumn("station", F.col("id") % 1000)
    return rows.join(close, "station", "left_semi").select("id")


@query("ai_station_geodesics", "SELECT c_custkey, true AS close FROM customer")
def sphere_and_spheroid(t: Tables) -> DataFrame:
    """The sphere's distance is within 0.6 % of the spheroid's."""
    prepare(t.spark)
    args = (*point(), F.lit(-102.0), F.lit(31.0))
    rows = places(t).select("c_custkey", geo.haversine(*args).alias("a"), geo.spheroid(*args).alias("b"))
    return rows.select("c_custkey", (F.abs(F.col("a") - F.col("b")) <= 0.006 * F.col("b")).alias("close"))


# series, values, json --------------------------------------------------------------------------------------

query("series_time", "SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02', INTERVAL 5 MINUTE)) AS ts")(lambda t: time_series(t.spark, datetime(2024, 1, 1), datetime(2024, 1, 2), timedelta(minutes=5)))
query("series_each", "SELECT l_orderkey, l_linenumber, CAST(unnest(generate_series(1, l_linenumber)) AS INT) AS k FROM lineitem")(lambda t: each_of(t.lineitem.select("l_orderkey", "l_linenumber"), F.lit(1), F.col("l_linenumber").cast("int"), "k"))
query("series_weeks", "SELECT time_bucket(INTERVAL '7 days', ts) AS week, count(*) AS n FROM events GROUP BY 1")(lambda t: t.events.groupBy(time_bucket(timedelta(days=7), "ts").alias("week")).agg(F.count("*").alias("n")))
query("series_cross", "SELECT n_nationkey, k FROM nation, (VALUES (1, 'a'), (2, 'b')) v(k, x)")(lambda t: t.nation.select("n_nationkey").crossJoin(F.broadcast(t.spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"))).drop("x"))
query("json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))


@query("json_messages", "SELECT 'user' AS role, 'hi' AS content")
def messages(t: Tables) -> DataFrame:
    """A JSON array of objects, built and read back by path."""
    text = F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit("be kind").alias("content")), F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))))
    return t.spark.range(1).select(F.get_json_object(text, "$[1].role").alias("role"), F.get_json_object(text, "$[1].content").alias("content"))


@query("semi_labels", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def labelled(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


query("string_agg", "SELECT n_regionkey, string_agg(n_name, chr(10) ORDER BY n_name) AS names FROM nation GROUP BY 1")(lambda t: t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("names")))
query("distinct_pairs", "SELECT DISTINCT user_id, event_type FROM events")(lambda t: t.events.select("user_id", "event_type").distinct())
query("rounding", "SELECT CAST(0.13 AS DOUBLE) AS a, 3 AS b, '12 kB' AS c, ['a', 'b c', NULL] AS d")(lambda t: t.spark.range(1).select(F.round(F.lit(0.125), 2).alias("a"), rint_int(F.lit(2.6)).alias("b"), pretty_bytes(F.lit(12_000)).alias("c"), pg_array(F.lit('{a,"b c",NULL}')).alias("d")))


@query("constraints", "SELECT * FROM (VALUES ('o_orderkey is not null', 0), ('o_orderstatus is one of 3 values', 0), ('o_orderkey is unique', 0), ('o_custkey refers to c_custkey', 0)) v(rule, violations)".replace(", 0)", ", CAST(0 AS BIGINT))"))
def constraints(t: Tables) -> DataFrame:
    return validate(t.orders, ["o_orderkey"], ["o_orderkey"], {"o_orderstatus": ["F", "O", "P"]}, {"o_custkey": (t.customer, "c_custkey")})


@query("outliers", "SELECT event_id, round((value - m) / s, 4) AS z FROM (SELECT event_id, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY event_type, time_bucket(INTERVAL '1 hour', ts))) WHERE s > 0 AND abs(value - m) > 2 * s")
def outliers(t: Tables) -> DataFrame:
    """Readings over two deviations from their type's hour: the hour's figures are one small row each."""
    key = ["event_type", "hour"]
    rows = t.events.withColumn("hour", time_bucket(timedelta(hours=1), "ts"))
    figures = rows.groupBy(*key).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return rows.join(figures, key).where((F.col("s") > 0) & (F.abs(F.col("value") - F.col("m")) > 2 * F.col("s"))).select("event_id", r4((F.col("value") - F.col("m")) / F.col("s")).alias("z"))


# streams and generators ------------------------------------------------------------------------------------


@query("stream_daily", "SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, event_type, round(avg(value), 8) AS mean, count(*) AS n FROM events WHERE ts < (SELECT time_bucket(INTERVAL '1 day', max(ts) - INTERVAL 1 HOUR) FROM events) GROUP BY 1, 2")
def stream_daily(t: Tables) -> DataFrame:
    """Closed days of a stream; the last day is still open."""
    source = new_path(t.spark, "stream-in")
    t.events.write.parquet(source)
    rows = t.spark.readStream.schema(t.events.schema).parquet(source)
    out = new_path(t.spark, "stream-out")
    buckets = bucket_stream(rows, "ts", "1 day", ["event_type"], [F.avg("value").alias("mean"), F.count("*").alias("n")], "1 hour")
    write_closed(buckets, out, new_path(t.spark, "stream-state")).awaitTermination()
    return t.spark.read.schema(buckets.schema).parquet(out).withColumn("mean", r8(F.col("mean")))


AS_OF = datetime(2024, 3, 1, 10, 30)


def _shape(name: str, make, key: str, sql: str) -> None:
    query(name, sql)(lambda t: make(t).groupBy(key).agg(F.count("*").alias("n")))


_shape("gen_rooms", lambda t: generators.room_readings(t.spark, AS_OF, days=2), "sensor_id", "SELECT CAST(unnest(generate_series(1, 4)) AS INT) AS sensor_id, CAST(34561 AS BIGINT) AS n")
_shape("gen_oee", lambda t: generators.oee_readings(t.spark, AS_OF), "line_id", "SELECT 'LINE-' || unnest(generate_series(1, 3)) AS line_id, CAST(120961 AS BIGINT) AS n")
_shape("gen_wells", lambda t: generators.well_readings(t.spark, AS_OF), "well_id", "SELECT CAST(unnest(generate_series(1, 20)) AS INT) AS well_id, CAST(8640 AS BIGINT) AS n")
_shape("gen_stages", lambda t: generators.frac_stages(t.spark, AS_OF), "stage_result", "SELECT * FROM (VALUES ('Screenout', CAST(15 AS BIGINT)), ('Completed', CAST(110 AS BIGINT))) v(stage_result, n)")
_shape("gen_schedule", lambda t: generators.pump_schedule(generators.frac_stages(t.spark, AS_OF)), "substage_number", "SELECT CAST(unnest(generate_series(1, 7)) AS INT) AS substage_number, CAST(125 AS BIGINT) AS n")
query("gen_telemetry", "SELECT CAST(179328 AS BIGINT) AS n")(lambda t: generators.frac_telemetry(generators.frac_stages(t.spark, AS_OF)).agg(F.count("*").alias("n")))
_shape("gen_wearables", lambda t: generators.wearable_readings(t.spark, AS_OF, days=1), "device_id", "SELECT CAST(unnest(generate_series(1, 4)) AS INT) AS device_id, CAST(17281 AS BIGINT) AS n")
_shape("gen_climate", lambda t: generators.climate_readings(t.spark, AS_OF, days=1), "sensor_id", "SELECT 'sensor_' || lpad(CAST(unnest(generate_series(1, 20)) AS VARCHAR), 2, '0') AS sensor_id, CAST(1440 AS BIGINT) AS n")
