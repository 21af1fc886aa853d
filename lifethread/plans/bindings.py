"""Adapters from the driver's tables to our schemas, in Spark and as the same views in SQL."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifethread.runtime import ship

_DAY = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INT)"

VIEWS = {
    "m_event": f"""
        SELECT event_id, user_id AS participant, ts, {_DAY} AS day,
          CAST(EXTRACT(HOUR FROM ts)*3600 + EXTRACT(MINUTE FROM ts)*60 AS DOUBLE)
            + CAST(floor(extract(microsecond from ts)/10000)/100.0 AS DOUBLE) + ({_DAY}-1)*86400.0 AS t_sec,
          concat('DAY', CAST({_DAY} AS VARCHAR), '_', strftime(ts,'%H%M%S'),
            lpad(CAST(CAST(floor((extract(microsecond from ts)%1000000)/10000) AS INT) AS VARCHAR),2,'0')) AS clip_ts,
          concat(event_type, ' ', regexp_extract(props, '([0-9]+)', 1)) AS caption, event_type, value,
          CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events""",
    "m_object": """
        SELECT event_id, 0 AS pos, 'object1' AS name, CONCAT('object_', lpad(CAST(k % 20 + 1 AS VARCHAR),3,'0')) AS global_name FROM m_event
        UNION ALL SELECT event_id, 1, 'human1', CONCAT('person_', lpad(CAST(participant % 10 + 1 AS VARCHAR),3,'0')) FROM m_event WHERE k % 3 <> 0
        UNION ALL SELECT event_id, 2, 'object2', CONCAT('object_', lpad(CAST(k % 20 + 1 AS VARCHAR),3,'0')) FROM m_event WHERE k % 5 = 0""",
    "m_entity": """
        SELECT DISTINCT global_name, CASE WHEN global_name LIKE 'person%' THEN 'Person' ELSE 'Object' END AS label
        FROM m_object WHERE global_name <> 'object_020'""",
    "m_next": """
        SELECT src, dst, 'NEXT_EVENT' AS type FROM (
          SELECT lag(event_id) OVER (PARTITION BY participant ORDER BY t_sec, event_id) AS src, event_id AS dst FROM m_event) t
        WHERE src IS NOT NULL""",
    "m_edge": """
        SELECT CONCAT('e', CAST(src AS VARCHAR)) AS src, CONCAT('e', CAST(dst AS VARCHAR)) AS dst, type FROM m_next
        UNION ALL SELECT DISTINCT CONCAT('e', CAST(o.event_id AS VARCHAR)), o.global_name, 'INVOLVES'
        FROM m_object o JOIN m_entity n ON o.global_name = n.global_name""",
    "m_rel": """
        SELECT e.event_id AS eid, concat(e.clip_ts, '_evt') AS event_id,
          CASE WHEN e.k % 7 = 0 THEN 'DAY0_00000000_evt' ELSE concat(p.clip_ts, '_evt') END AS related_event_id, p.event_id AS related_eid,
          CASE e.k % 5 WHEN 0 THEN 'causal' WHEN 1 THEN 'same_activity_non_causal' WHEN 2 THEN 'no_relationship'
            WHEN 3 THEN 'related_to' ELSE 'causal_same_strong' END AS type, e.caption AS reason, e.participant
        FROM m_next n JOIN m_event e ON e.event_id = n.dst JOIN m_event p ON p.event_id = n.src""",
    "m_vec": """
        SELECT v.vec_id AS event_id, CAST(v.embedding AS DOUBLE[]) AS vec, v.label FROM embeddings v JOIN m_event e ON e.event_id = v.vec_id""",
    "m_mention": """
        SELECT o.global_name AS entity, o.event_id, o.pos, e.t_sec, e.caption AS description, v.vec
        FROM m_object o JOIN m_event e ON e.event_id = o.event_id JOIN m_vec v ON v.event_id = o.event_id""",
    "m_known": """
        SELECT n.global_name, n.label, d.vec FROM m_entity n JOIN (SELECT entity, last(vec ORDER BY t_sec, event_id, pos) AS vec FROM m_mention GROUP BY 1) d ON d.entity = n.global_name""",
    "m_ties": """
        SELECT DISTINCT CONCAT('e', CAST(o.event_id AS VARCHAR)) AS src, o.global_name AS dst FROM m_object o JOIN m_entity n ON n.global_name = o.global_name""",
    "m_question": """
        SELECT CONCAT('e', CAST(v.event_id AS VARCHAR)) AS qid, v.vec, e.t_sec AS query_t, e.k % 3 <> 0 AS want_event, e.k % 2 = 0 AS want_object, e.k % 5 = 0 AS want_person, e.event_type, e.k, e.value
        FROM m_vec v JOIN m_event e ON e.event_id = v.event_id""",
    "m_core": """
        WITH es AS (SELECT q.qid, CONCAT('e', CAST(c.event_id AS VARCHAR)) AS id, q.query_t, round(list_cosine_similarity(q.vec, c.vec), 9) AS sim FROM m_question q JOIN m_vec c ON q.want_event),
        et AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rn FROM es WHERE sim >= 0),
        hits AS (SELECT et.qid, et.id AS event_id, e.t_sec, et.sim FROM et JOIN m_event e ON CONCAT('e', CAST(e.event_id AS VARCHAR)) = et.id WHERE rn <= 6 AND e.t_sec <= et.query_t),
        ns AS (SELECT q.qid, n.global_name AS id, n.label, round(list_cosine_similarity(q.vec, n.vec), 9) AS sim FROM m_question q JOIN m_known n ON (n.label = 'Object' AND q.want_object) OR (n.label = 'Person' AND q.want_person)),
        found AS (SELECT qid, id AS entity FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY sim DESC, id) AS rn FROM ns WHERE sim >= 0) WHERE rn <= 6),
        touch AS (SELECT h.qid, h.event_id FROM hits h JOIN m_ties t ON t.src = h.event_id JOIN found f ON f.qid = h.qid AND f.entity = t.dst),
        direct AS (SELECT * FROM hits WHERE (qid, event_id) IN (SELECT (qid, event_id) FROM touch) OR qid NOT IN (SELECT qid FROM touch)),
        thru AS (SELECT DISTINCT f.qid, t.src AS event_id, e.t_sec FROM found f JOIN m_ties t ON t.dst = f.entity JOIN m_event e ON CONCAT('e', CAST(e.event_id AS VARCHAR)) = t.src JOIN m_question q ON q.qid = f.qid
          WHERE f.qid NOT IN (SELECT qid FROM hits) AND e.t_sec <= q.query_t),
        both_ways AS (SELECT qid, event_id, t_sec, sim FROM direct UNION ALL SELECT qid, event_id, t_sec, NULL FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY t_sec DESC, event_id DESC) AS rn FROM thru) WHERE rn <= 10)
        SELECT qid, event_id, t_sec, sim AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY t_sec DESC, event_id DESC) AS rn FROM both_ways) WHERE rn <= 20""",
    "m_hits": """
        WITH ev AS (SELECT CONCAT('e', CAST(event_id AS VARCHAR)) AS id, t_sec, clip_ts, caption FROM m_event),
        adj AS (SELECT src AS a, dst AS b, type FROM m_edge UNION ALL SELECT dst, src, type FROM m_edge),
        one AS (SELECT c.qid, c.event_id AS core, c.t_sec AS core_t, a.b AS node, a.type AS rel FROM m_core c JOIN adj a ON a.a = c.event_id),
        reach AS (SELECT qid, core, core_t, rel, node AS nb FROM one UNION SELECT o.qid, o.core, o.core_t, o.rel, a.b FROM one o JOIN adj a ON a.a = o.node),
        near AS (SELECT r.*, e.t_sec FROM reach r JOIN ev e ON e.id = r.nb WHERE e.t_sec <> r.core_t),
        wide AS (SELECT DISTINCT qid, nb AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY t_sec DESC, nb, rel, core) AS rn FROM near) WHERE rn <= 10),
        core AS (SELECT c.qid, c.event_id, e.t_sec, e.clip_ts AS timestamp, e.caption, c.similarity, true AS is_core FROM m_core c JOIN ev e ON e.id = c.event_id),
        more AS (SELECT w.qid, w.event_id, e.t_sec, e.clip_ts AS timestamp, e.caption FROM wide w JOIN ev e ON e.id = w.event_id)
        SELECT * FROM core UNION ALL SELECT qid, event_id, t_sec, timestamp, caption, NULL, false FROM more m WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.qid = m.qid AND c.timestamp = m.timestamp)""",
    "m_speech": """
        SELECT conv_id AS event_id, turn AS pos, CASE WHEN role = 'system' THEN NULL ELSE role END AS speaker, text,
          CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS DOUBLE)/16.0 - turn*0.25 AS start_time,
          CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)/16.0 AS end_time,
          CASE turn % 3 WHEN 0 THEN 'I' WHEN 1 THEN concat('desc', CAST(conv_id % 5 AS VARCHAR)) ELSE NULL END AS description,
          CASE WHEN conv_id % 9 = 8 THEN NULL ELSE concat('voice_', CAST(conv_id % 40 AS VARCHAR)) END AS global_voice
        FROM conversations""",
    "m_turn": """
        SELECT event_id AS recording_id, pos, start_time AS start, end_time AS "end", coalesce(speaker, 'none') AS label FROM m_speech""",
    "m_face": """
        SELECT event_id AS recording_id, pos, start_time + 1.0 AS start, end_time + 0.5 AS "end", concat('f', CAST(pos % 3 AS VARCHAR)) AS label FROM m_speech""",
    "m_voice": """
        WITH v AS (SELECT DISTINCT conv_id % 40 AS n FROM conversations)
        SELECT concat('voice_', CAST(n AS VARCHAR)) AS voice_id, 0 AS ordinal, 'I' AS related_name FROM v WHERE n % 4 = 0
        UNION ALL SELECT concat('voice_', CAST(n AS VARCHAR)), 1, 'SPEAKER_00' FROM v
        UNION ALL SELECT concat('voice_', CAST(n AS VARCHAR)), 2, concat('person_', lpad(CAST(n % 12 + 1 AS VARCHAR),3,'0')) FROM v WHERE n % 5 <> 0
        UNION ALL SELECT concat('voice_', CAST(n AS VARCHAR)), 3, concat('person_', lpad(CAST((n + 3) % 12 + 1 AS VARCHAR),3,'0')) FROM v WHERE n % 7 <> 0""",
    "m_box": """
        SELECT l_orderkey AS event_id, l_linenumber AS frame, l_quantity AS x, l_discount*100 AS y, 10 + l_tax*100 AS w, CAST(12.0 AS DOUBLE) AS h,
          l_quantity + l_suppkey % 5 AS dx, l_discount*100 + l_partkey % 4 AS dy, concat('c', CAST(l_suppkey % 3 AS VARCHAR)) AS candidate FROM lineitem""",
    "m_trial": """
        SELECT DISTINCT l.l_partkey AS enrol, l.l_suppkey AS test, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS target
        FROM lineitem l JOIN embeddings a ON a.vec_id = l.l_partkey JOIN embeddings b ON b.vec_id = l.l_suppkey""",
    "m_scored": """
        SELECT t.enrol, t.test, t.target, b.label AS test_label,
          round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score
        FROM m_trial t JOIN embeddings a ON a.vec_id = t.enrol JOIN embeddings b ON b.vec_id = t.test""",
    "m_score": """
        SELECT d.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS score, l.quality AS target, d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "m_target": """
        SELECT l_orderkey AS event_id, concat('object', CAST(l_linenumber AS VARCHAR)) AS name, l_linestatus AS description,
          CASE WHEN l_returnflag = 'N' THEN '' ELSE concat('act', CAST(l_suppkey % 7 AS VARCHAR)) END AS action,
          l_quantity/10.0 AS seg1, 1.0 + l_discount*20.0 AS seg2,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag, l_linestatus) - 1 AS pos
        FROM lineitem""",
}
_ORDER = list(VIEWS)


def oracle(sql: str) -> str:
    """``sql`` with the views it uses, directly or through others, written before it."""
    need: set[str] = set()
    todo = [sql]
    while todo:
        for name in set(re.findall(r"\bm_[a-z]+\b", todo.pop())):
            if name in VIEWS and name not in need:
                need.add(name)
                todo.append(VIEWS[name])
    heads = [f"{n} AS ({VIEWS[n]})" for n in _ORDER if n in need]
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"(?i)with\s+recursive\b", body) else ""
    own = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if not heads:
        return body
    if own:
        return f"WITH {recursive}" + ",\n".join(heads) + ",\n" + body[own.end():]
    return "WITH " + ",\n".join(heads) + "\n" + body


class Tables:
    """The driver's tables and the adapters on them, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        ship(spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def event(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp_ntz")
        day = (F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")) + 1).cast("int")
        second = F.expr("CAST(floor(extract(SECOND FROM ts) * 100) / 100.0 AS DOUBLE)")
        k = F.regexp_extract("props", "([0-9]+)", 1)
        return self.read("events").select(
            "event_id", F.col("user_id").alias("participant"), ts.alias("ts"), day.alias("day"),
            ((F.hour(ts) * 3600 + F.minute(ts) * 60).cast("double") + second + (day - 1) * F.lit(86400.0)).alias("t_sec"),
            F.concat(F.lit("DAY"), day.cast("string"), F.lit("_"), F.date_format(ts, "HHmmssSS")).alias("clip_ts"),
            F.concat("event_type", F.lit(" "), k).alias("caption"), "event_type", "value", k.cast("int").alias("k"),
        )

    @cached_property
    def object(self) -> DataFrame:
        number = lambda c: F.lpad(c.cast("string"), 3, "0")
        thing = F.concat(F.lit("object_"), number(F.col("k") % 20 + 1))
        person = F.concat(F.lit("person_"), number(F.col("participant") % 10 + 1))
        made = lambda pos, name, gname, keep: F.when(
            keep, F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("name"), gname.alias("global_name"))
        )
        all_three = F.array(
            made(0, "object1", thing, F.lit(True)), made(1, "human1", person, F.col("k") % 3 != 0), made(2, "object2", thing, F.col("k") % 5 == 0)
        )
        return self.event.select("event_id", F.inline(F.filter(all_three, lambda o: o.isNotNull())))

    @cached_property
    def entity(self) -> DataFrame:
        label = F.when(F.startswith("global_name", F.lit("person")), "Person").otherwise("Object")
        return self.object.where("global_name <> 'object_020'").select("global_name").distinct().withColumn("label", label)

    @cached_property
    def next(self) -> DataFrame:
        from lifethread.operators.graph import build_chains

        return build_chains(self.event.select("participant", "event_id", "t_sec"), split=False).select("src", "dst", "type")

    def eid(self, col: str):
        return F.concat(F.lit("e"), F.col(col).cast("string"))

    @cached_property
    def edge(self) -> DataFrame:
        involves = self.object.join(self.entity, "global_name", "left_semi").select(
            self.eid("event_id").alias("src"), F.col("global_name").alias("dst"), F.lit("INVOLVES").alias("type")
        ).distinct()
        return self.next.select(self.eid("src").alias("src"), self.eid("dst").alias("dst"), "type").unionByName(involves)

    @cached_property
    def rel(self) -> DataFrame:
        e, p = self.event, self.event.select(F.col("event_id").alias("src"), F.col("clip_ts").alias("_past"))
        kind = (
            F.when(F.col("k") % 5 == 0, "causal").when(F.col("k") % 5 == 1, "same_activity_non_causal")
            .when(F.col("k") % 5 == 2, "no_relationship").when(F.col("k") % 5 == 3, "related_to").otherwise("causal_same_strong")
        )
        return (
            self.next.select("src", "dst").join(e, F.col("dst") == e["event_id"]).join(p, "src").select(
                F.col("dst").alias("eid"), F.concat("clip_ts", F.lit("_evt")).alias("event_id"),
                F.when(F.col("k") % 7 == 0, "DAY0_00000000_evt").otherwise(F.concat("_past", F.lit("_evt"))).alias("related_event_id"),
                F.col("src").alias("related_eid"), kind.alias("type"), F.col("caption").alias("reason"), "participant",
            )
        )

    @cached_property
    def vec(self) -> DataFrame:
        v = self.read("embeddings").select(F.col("vec_id").alias("event_id"), F.col("embedding").alias("vec"), "label")
        return v.join(self.event.select("event_id"), "event_id", "left_semi")

    @cached_property
    def mention(self) -> DataFrame:
        e = self.event.select("event_id", "t_sec", F.col("caption").alias("description"))
        return self.object.select(F.col("global_name").alias("entity"), "event_id", "pos").join(e, "event_id").join(
            self.vec.select("event_id", "vec"), "event_id"
        )

    @cached_property
    def question(self) -> DataFrame:
        k = F.col("k")
        e = self.event.select("event_id", F.col("t_sec").alias("query_t"), "event_type", "k", "value")
        return self.vec.select("event_id", "vec").join(e, "event_id").select(
            self.eid("event_id").alias("qid"), "vec", "query_t", (k % 3 != 0).alias("want_event"), (k % 2 == 0).alias("want_object"),
            (k % 5 == 0).alias("want_person"), "event_type", "k", "value",
        )

    @cached_property
    def graph(self):
        from lifethread.plans.retrieval import Graph

        events = self.event.select("event_id", F.col("clip_ts").alias("timestamp"), "t_sec", "caption").join(
            self.vec.select("event_id", "vec"), "event_id", "left"
        ).withColumn("event_id", self.eid("event_id"))
        last = self.mention.groupBy("entity").agg(F.max_by("vec", F.struct("t_sec", "event_id", "pos")).alias("vec"))
        entities = self.entity.join(last.withColumnRenamed("entity", "global_name"), "global_name", "left")
        return Graph(events, entities, self.edge)

    @cached_property
    def speech(self) -> DataFrame:
        w = Window.partitionBy("conv_id").orderBy("turn")
        chars = lambda frame: F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(*frame)), F.lit(0)).cast("double") / F.lit(16.0)
        desc = F.when(F.col("turn") % 3 == 0, "I").when(F.col("turn") % 3 == 1, F.concat(F.lit("desc"), (F.col("conv_id") % 5).cast("string")))
        return self.read("conversations").select(
            F.col("conv_id").alias("event_id"), F.col("turn").alias("pos"), F.when(F.col("role") != "system", F.col("role")).alias("speaker"), "text",
            (chars((Window.unboundedPreceding, -1)) - F.col("turn") * F.lit(0.25)).alias("start_time"),
            chars((Window.unboundedPreceding, 0)).alias("end_time"), desc.alias("description"),
            F.when(F.col("conv_id") % 9 != 8, F.concat(F.lit("voice_"), (F.col("conv_id") % 40).cast("string"))).alias("global_voice"),
        )

    @cached_property
    def turn(self) -> DataFrame:
        return self.speech.select(
            F.col("event_id").alias("recording_id"), "pos", F.col("start_time").alias("start"), F.col("end_time").alias("end"),
            F.coalesce("speaker", F.lit("none")).alias("label"),
        )

    @cached_property
    def face(self) -> DataFrame:
        return self.speech.select(
            F.col("event_id").alias("recording_id"), "pos", (F.col("start_time") + 1.0).alias("start"), (F.col("end_time") + 0.5).alias("end"),
            F.concat(F.lit("f"), (F.col("pos") % 3).cast("string")).alias("label"),
        )

    @cached_property
    def voice(self) -> DataFrame:
        n = F.col("n")
        person = lambda c: F.concat(F.lit("person_"), F.lpad((c % 12 + 1).cast("string"), 3, "0"))
        row = lambda o, name, keep: F.when(keep, F.struct(F.lit(o).alias("ordinal"), name.alias("related_name")))
        rows = F.array(
            row(0, F.lit("I"), n % 4 == 0), row(1, F.lit("SPEAKER_00"), F.lit(True)), row(2, person(n), n % 5 != 0), row(3, person(n + 3), n % 7 != 0)
        )
        voices = self.read("conversations").select((F.col("conv_id") % 40).alias("n")).distinct()
        return voices.select(F.concat(F.lit("voice_"), n.cast("string")).alias("voice_id"), F.inline(F.filter(rows, lambda r: r.isNotNull())))

    @cached_property
    def box(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("frame"), F.col("l_quantity").alias("x"),
            (F.col("l_discount") * 100).alias("y"), (10 + F.col("l_tax") * 100).alias("w"), F.lit(12.0).alias("h"),
            (F.col("l_quantity") + F.col("l_suppkey") % 5).alias("dx"), (F.col("l_discount") * 100 + F.col("l_partkey") % 4).alias("dy"),
            F.concat(F.lit("c"), (F.col("l_suppkey") % 3).cast("string")).alias("candidate"),
        )

    @cached_property
    def trial(self) -> DataFrame:
        v = self.read("embeddings").select("vec_id", "label")
        pairs = self.read("lineitem").select(F.col("l_partkey").alias("enrol"), F.col("l_suppkey").alias("test")).distinct()
        a, b = v.toDF("enrol", "_a"), v.toDF("test", "_b")
        return pairs.join(a, "enrol").join(b, "test").select(
            "enrol", "test", F.when(F.col("_a") == F.col("_b"), 1).otherwise(0).alias("target"), F.col("_b").alias("test_label")
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")

    @cached_property
    def score(self) -> DataFrame:
        return self.read("documents").select("doc_id", "n_chars", "source").join(self.read("labels").select("doc_id", "quality"), "doc_id").select(
            F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("target"), "source"
        )

    @cached_property
    def target(self) -> DataFrame:
        """One event per order with its lines as interaction targets, in line order."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"]
        seg = lambda a, b: F.struct(a.alias("start_time"), b.alias("end_time"))
        lines = self.read("lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(
            F.sort_array(F.collect_list(F.struct(*order))).alias("_lines")
        )
        as_target = lambda x: F.struct(
            F.concat(F.lit("object"), x["l_linenumber"].cast("string")).alias("name"), x["l_linestatus"].alias("description"),
            F.when(x["l_returnflag"] == "N", "").otherwise(F.concat(F.lit("act"), (x["l_suppkey"] % 7).cast("string"))).alias("action"),
            F.lit("").alias("location"),
            F.array(seg(F.lit(0.0), x["l_quantity"] / F.lit(10.0)), seg(F.lit(1.0), F.lit(1.0) + x["l_discount"] * F.lit(20.0))).alias("interaction_segments"),
        )
        return lines.select("event_id", F.transform("_lines", as_target).alias("interaction_object"))
