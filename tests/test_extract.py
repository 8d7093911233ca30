"""Golden cases of decoding, alias lookup, blocks, scores, identifiers and derivation."""

from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.functions import text as T
from kinfold.operators.blocks import light_block
from kinfold.operators.derive import source_columns
from kinfold.operators.typed import exact_kind
from kinfold.plans import extract as E
from kinfold.plans.extract import contribute
from kinfold.sources.envelope import dead_letters, messages

from helpers import by_offset, contributed, envelopes, extracted, plain


def test_envelopes_split_into_messages_and_dead_letters(spark):
    bodies = ['{"id": 1}', "{invalid json}", "", b"\xff\xfe invalid", "[1]", "5", "null", "{}", '{"a":1} tail',
              '{"a":1}{"b":2}', '{"a":1},{"b":2}', "{'a':1}", ' {"a":"1","b":"2","a":"3"} ', '{"n":{"a":1,"a":2}}']
    records = envelopes(spark, bodies)
    assert sorted(r["offset"] for r in messages(records).collect()) == [0, 7, 12, 13]
    dead = dead_letters(records).collect()
    assert sorted(r["offset"] for r in dead) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11]
    assert {r["offset"]: bytes(r["value"]) for r in dead}[3] == b"\xff\xfe invalid"


def test_identifiers_follow_document_order_and_types(spark):
    rows = extracted(spark, [
        {"correo": "A@x.es", "email": "b@x.es"}, {"correo": None, "email": "b@x.es"},
        {"n": {"mail": "1@x.es", "correo": "2@x.es"}}, {"n": {"email": "in@x.es"}, "email": "out@x.es"},
        {"passport": 123}, {"nif": "X1"}, {"ssn": "9"}, {"telfnumber": "+34 1"},
        {"name": " Ana  B ", "dob": "2000-01-01"}, '{"email":"a@x.es","email":"z@x.es"}', {"PASSPORT": "\tAb  c\n"}])
    assert [rows[i]["id_email"] for i in range(4)] == ["a@x.es", None, "1@x.es", "out@x.es"]
    assert rows[4]["id_passport"] is None and rows[4]["proposed_key"] == "rawid::hr_0_4"
    assert (rows[5]["id_passport"], rows[5]["id_tax_id"]) == ("x1", "x1")
    assert (rows[6]["id_tax_id"], rows[6]["id_ssn"], rows[6]["proposed_key"]) == ("9", "9", "rawid::hr_0_6")
    assert rows[7]["id_phone"] is None
    assert rows[8]["proposed_key"] == "fullnamedob::ana b::2000-01-01"
    assert rows[9]["id_email"] == "z@x.es"
    assert rows[10]["id_passport"] == "ab c"


def test_blocks(spark):
    rows = extracted(spark, [
        {"IBAN": " es79AB "}, {"bank": "x", "note": "new Software here"}, {"url": "http://ab:80"},
        {"iban": 0, "x": "es12xx1234567890123"}, {"city": "", "town": "Rome", "zip": 0, "state": [], "lat": None},
        {"company": "  ACME  Ltd ", "salary": 12.5}, {"ip": ["10.0.0.1"], "z": "at 1.2.3.4 now"}])
    assert rows[0]["b_bank"]["iban"] == "es79AB"
    assert rows[1]["b_bank"] == {"bank_name": "x", "swift": "SOFTWARE"}
    assert rows[2]["b_net"] == {"url": "http://ab:80", "ipv6": "http://ab:80"}
    assert rows[3]["b_bank"]["iban"] == "ES12XX1234567890123"
    assert rows[4]["b_location"] == {"postal_code": 0}
    assert rows[5]["b_professional"]["company"] == "acme ltd" and float(rows[5]["b_professional"]["salary"]) == 12.5
    assert rows[6]["b_net"]["ipv4"] == ["10.0.0.1"]


def test_scores_and_ties(spark):
    rows = extracted(spark, [
        {"q": True}, {"iban": "x", "city": "y"}, {"note": "Philip"}, {"note": "aeiou", "list": ["my street", 3]},
        {"n": {"company": "a"}}])
    assert [rows[i]["kind"] for i in range(5)] == ["unknown", "bank", "net", "location", "professional"]


def test_swift_needs_a_word_boundary_in_any_script(spark):
    rows = extracted(spark, [{"note": "éabcdefgh"}, {"note": "é abcdefgh"}, {"note": "straßenx"}, {"note": "straßen"}])
    assert "swift" not in rows[0]["b_bank"]
    assert rows[1]["b_bank"]["swift"] == "ABCDEFGH"
    # Upper-casing makes nine letters of eight: no eight-letter code.
    assert "swift" not in rows[2]["b_bank"] and rows[2]["kind"] == "unknown"
    assert rows[3]["b_bank"]["swift"] == "STRASSEN" and rows[3]["kind"] == "bank"


def test_metadata_scan_is_an_option(spark):
    body = [{"q": True}]
    records = messages(envelopes(spark, body, topic="metadata"))
    from kinfold.config import Config
    from kinfold.plans.extract import extract
    assert by_offset(extract(records))[0]["kind"] == "unknown"
    scanned = by_offset(extract(records, Config(scan_metadata=True)))[0]
    assert scanned["kind"] == "bank" and scanned["b_bank"]["swift"] == "METADATA"


def test_derived_blocks(spark):
    rows = by_offset(contributed(spark, [
        {"IBAN": " es79AB "}, {"iban": "XX12"}, {"email": "a@gmail.com"}, {"email": "a@mail.tele2.it"},
        {"domain": "www.acme.com"}, {"email": "a@www"}, {"phone": "1"}, {"company": "Beta", "email": "a@acme.com"}]))
    assert rows[0]["c_location"] == {"country_code": "ES", "country": "Spain"}
    assert rows[1]["c_location"] == {"country_code": "XX"}
    assert rows[2]["c_net"] == {"domain": "gmail.com"} and rows[2]["c_professional"] is None
    assert rows[3]["c_professional"] == {"company": "Tele2", "_inferred": True}
    assert rows[4]["c_professional"] == {"company": "Acme", "_inferred": True} and rows[4]["c_net"]
    assert rows[5]["c_professional"] is None
    assert rows[6]["c_personal"] == {"phone": "1"}
    assert rows[7]["c_professional"] == {"company": "beta"} and "professional" in rows[7]["observed"]


def test_exact_rules_are_case_sensitive(spark):
    bodies = [{"Name": "a", "Last_name": "b", "Sex": "M"}, {"name": "a", "last_name": "b", "sex": "M"},
              {"fullname": "a", "city": "b", "address": "c", "company": "d"},
              {"fullname": "a", "city": "b", "address": "c"}, {"fullname": "a", "company": "d", "job": "e"},
              {"passport": "a", "IBAN": "b", "salary": "c"}, {"IPv4": "a", "address": "b"}]
    rows = messages(envelopes(spark, bodies)).select("offset", exact_kind(F.col("fields")).alias("kind"))
    assert [r["kind"] for r in rows.orderBy("offset").collect()] == [
        None, "personal", None, "location", "professional", "bank", "net"]


def test_light_block_keeps_scalars(spark):
    body = [{"a": "x", "_b": 1, "c": [1], "d": {"e": 1}, "f": None, "g": False}]
    rows = messages(envelopes(spark, body)).select(light_block(F.col("fields")).alias("b"))
    assert plain(rows.first()["b"]["raw"]) == {"a": "x", "g": False}


def test_column_names_and_company_labels(spark):
    names = [" A-b ", "a__b", "9x", "--", "", "Ünï"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(T.column_name(F.col("n")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["a_b", "a_b", "c_9x", "col", "col", "n"]
    domains = ["acme.com", "GMAIL.com", "mail.x.co", "solo", "www.mail", "..", "a b.c"]
    rows = spark.createDataFrame([(d,) for d in domains], "d string").select(
        T.company_from_domain(F.col("d")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["Acme", None, "X", "Solo", None, None, "A b"]


def test_alias_keys_are_unique_within_a_kind():
    for fields in V.ALIASES.values():
        keys = [a for aliases in fields.values() for a in aliases]
        assert len(keys) == len(set(keys)) and all(k == k.lower() for k in keys)


def test_extraction_stays_one_narrow_stage(spark):
    plan = contribute(messages(envelopes(spark, [{"a": 1}])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_columns_that_every_message_has_need_no_lambda(spark):
    # Spark interprets lambdas; these columns are made for all messages and were most of the time of an extraction.
    for columns in (E._identifier_columns(), E._key_columns(), source_columns(), {"observed": E._contribution_columns()["observed"]}):
        for name, column in columns.items():
            assert "lambda" not in str(column).lower(), name


def test_first_alias_counts_even_when_useless(spark):
    rows = extracted(spark, [
        {"town": "", "city": "Rome", "zip": 1}, {"swift": "", "iban_code": "a", "IBAN": "b", "z": "DEUTDEFF"},
        {"a": "x\nbank\ny", "b": "ßes12xx1234567890123", "c": "es12xx1234567890123"}, {"ip": "", "z": "my ip is 10.0.0.1"}])
    assert rows[0]["b_location"] == {"postal_code": 1}
    assert list(rows[1]["b_bank"].items()) == [("iban", "a"), ("swift", "DEUTDEFF")]
    assert rows[2]["b_bank"] == {"iban": "ES12XX1234567890123"} and rows[2]["kind"] == "bank"
    assert rows[3]["b_net"] == {"ipv4": "10.0.0.1"} and rows[3]["kind"] == "net"


def test_fields_of_short_messages_are_read_without_lambdas(spark):
    for column in (E._stream_columns()["texts"], E._norm_columns()["norms"]):
        assert "slice(" in str(column) and "lambda" not in str(column).lower().rsplit("else", 1)[0]
    # Those of long ones, and blocks of many fields, are read by lambdas with the same results.
    short = {"Town": " Rome ", "zip": 0, "CITY": "Oslo", "IBAN": " es79AB ", "swift": "", "note": "my bank"}
    full = {"city": "Rome", "addr": "A", "zip": "1", "pais": "IT", "lat": 1.5, "lon": ["x"], "town": "Oslo", "state": ""}
    filler = {f"f{i}": i for i in range(12)}
    rows = extracted(spark, [short, {**short, **filler}, full, {**full, **filler}])
    assert rows[0]["b_location"] == {"city": "rome", "postal_code": 0} and rows[0]["b_bank"] == {"iban": "es79AB"}
    assert set(rows[2]["b_location"]) == {"city", "address", "postal_code", "country", "latitude", "longitude"}
    for a, b in ((0, 1), (2, 3)):
        assert all(rows[a][f"b_{k}"] == rows[b][f"b_{k}"] for k in V.KINDS) and rows[a]["kind"] == rows[b]["kind"]


def test_lines_are_counted_as_strings(spark):
    # Counted at once, one string after another (a list, an escape), and where a string holds a break.
    rows = extracted(spark, [
        {"a": "my bank", "b": "swift account", "c": "street city", "d": "name"},
        {"a": ["my bank", "swift account"], "c": "street city", "d": "name"},
        {"a": "my bank\nswift account", "c": "street", "d": "city"},
        {"a": "calle", "b": "es12xx1234567890123", "c": "DE12XX1234567890123", "d": "pais"}])
    assert [rows[i]["kind"] for i in range(4)] == ["bank", "bank", "location", "bank"]
