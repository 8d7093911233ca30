"""Message view over the star-schema tables: every operator runs on messages made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.sources.envelope import raw_id, with_fields

EMAIL = ("concat('U', {0}, '@', case {0} % 4 when 0 then 'gmail.com' when 1 then 'ACME.com' "
         "when 2 then 'mail.Globex.org' else 'initech.co.uk' end)")
PHONE = "concat('+34 ', {0} + 600000000)"
STREET = "concat(c_custkey % 500, ' Main Street')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """The table that drives a view, over all cores where it is a few small files that cannot be split.

    Making and parsing messages costs far more than moving such rows. A table of as many files as there are cores, any
    large one that is, is left as it is, whatever other sources it is read with.
    """
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(cores, key)


def _message(rows: DataFrame, topic: str, key: str, ts: str, payload: str) -> DataFrame:
    return rows.selectExpr(
        f"'{topic}' as topic", f"cast({key} % 3 as int) as partition", f"cast({key} div 3 as bigint) as offset",
        f"cast({ts} as timestamp) as ts", f"{payload} as payload")


def _after(day: str, seconds: str) -> str:
    return f"timestamp_seconds(unix_timestamp('{day} 00:00:00') + {seconds})"


def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _message(
        _source(spark, sf_dir, "customer", "c_custkey"), "hr.personal", "c_custkey", _after("2023-01-01", "c_custkey"),
        f"""to_json(named_struct(
            'name', c_name, 'last_name', concat('L', c_custkey % 97),
            'sex', array(if(c_custkey % 2 = 0, 'M', 'F')), 'telfnumber', concat('+34 ', c_custkey),
            'passport', concat('P', c_custkey), 'email', {EMAIL.format('c_custkey')}))""")


def location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth message nests its fields."""
    rows = _source(spark, sf_dir, "customer", "c_custkey").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return _message(
        rows, "hr.location", "c_custkey", _after("2023-06-01", "c_custkey"),
        f"""if(c_custkey % 5 = 0,
            to_json(named_struct('who', named_struct('fullname', c_name),
                                 'where', named_struct('city', n_name, 'address', {STREET}))),
            to_json(named_struct('fullname', c_name, 'city', n_name, 'address', {STREET})))""")


def professional(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, "supplier", "s_suppkey").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return _message(
        rows, "hr.professional", "s_suppkey", _after("2023-09-01", "s_suppkey"),
        """to_json(named_struct(
            'fullname', s_name, 'company', concat(s_name, ' Trading'), 'company address', concat(n_name, ' 1'),
            'company_telfnumber', concat('+49 ', s_suppkey),
            'company_email', concat('info@s', s_suppkey, '.example'), 'job', 'Analyst'))""")


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _message(
        _source(spark, sf_dir, "orders", "o_orderkey"), "hr.bank", "o_orderkey", "o_orderdate",
        """to_json(named_struct(
            'passport', concat(' p', o_custkey, ' '),
            'IBAN', concat(case o_orderkey % 4 when 0 then 'ES' when 1 then 'FR' when 2 then 'DE' else 'XX' end,
                           lpad(o_orderkey % 100, 2, '0'), lpad(o_orderkey, 18, '0')),
            'salary', cast(cast(o_totalprice as decimal(15,2)) as string)))""")


def net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the messages carry no passport: e-mail, phone, both or nothing."""
    return _message(
        _source(spark, sf_dir, "events", "event_id"), "hr.net", "event_id", "ts",
        f"""to_json(named_struct(
            'address', concat('node ', event_id % 100),
            'IPv4', concat('10.', event_id % 200, '.', user_id % 250, '.', event_id % 7),
            'passport', case when event_id % 8 in (1, 5, 6, 7) then concat('P', user_id) end,
            'email', case when event_id % 8 in (0, 2, 4) then {EMAIL.format('user_id')} end,
            'phone', case when event_id % 8 in (2, 3) then {PHONE.format('user_id')} end))""")


def free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as messages."""
    return _message(
        _source(spark, sf_dir, "documents", "doc_id"), "hr.text", "doc_id", _after("2023-11-01", "doc_id"),
        "to_json(named_struct('doc', doc_id, 'text', text, 'lang', lang, 'source', source))")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _message(
        _source(spark, sf_dir, "conversations", "conv_id"), "hr.chat", "(conv_id * 1000 + turn)",
        _after("2023-12-01", "conv_id"), "to_json(named_struct('turn', turn, 'role', role, 'text', text))")


KIND_VIEWS = {"personal": personal, "location": location, "professional": professional, "bank": bank, "net": net}
VIEWS = {**KIND_VIEWS, "text": free_text, "chat": chat}


def landed(spark: SparkSession, sf_dir: str, *views: str) -> DataFrame:
    """Landed rows ``topic, partition, offset, ts, payload, raw_id`` of the named views (default: five kinds)."""
    names = views or tuple(KIND_VIEWS)
    rows = reduce(DataFrame.unionByName, [VIEWS[v](spark, sf_dir) for v in names])
    return rows.withColumn("raw_id", raw_id())


def messages(spark: SparkSession, sf_dir: str, *views: str) -> DataFrame:
    return with_fields(landed(spark, sf_dir, *views))


def envelopes(spark: SparkSession, sf_dir: str, *views: str) -> DataFrame:
    """The same messages as broker records."""
    return landed(spark, sf_dir, *views).select(
        "topic", "partition", "offset", F.col("ts").alias("timestamp"),
        F.col("payload").cast("binary").alias("value"))
