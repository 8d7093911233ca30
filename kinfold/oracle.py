"""SQL each registered query is checked against, in DuckDB's dialect.

The common table expressions restate the rules over exploded JSON entries, independent of how
the engine evaluates them.
"""

from __future__ import annotations

from kinfold import vocabulary as V

ORACLE: dict[str, str] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _mail(k: str) -> str:
    return (f"'U' || {k} || '@' || CASE {k} % 4 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'ACME.com' "
            f"WHEN 2 THEN 'mail.Globex.org' ELSE 'initech.co.uk' END")


def _message(topic: str, key: str, ts: str, payload: str, tables: str) -> str:
    return (f"SELECT '{topic}' AS topic, CAST({key} % 3 AS INTEGER) AS part, CAST({key} // 3 AS BIGINT) AS off, "
            f"{ts} AS ts, CAST({payload} AS VARCHAR) AS payload FROM {tables}")


STREET = "(c_custkey % 500) || ' Main Street'"
VIEWS = {
    "personal": _message(
        "hr.personal", "c_custkey", "TIMESTAMP '2023-01-01' + to_seconds(c_custkey)",
        "json_object('name', c_name, 'last_name', 'L' || (c_custkey % 97), "
        "'sex', json_array(CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END), 'telfnumber', '+34 ' || c_custkey, "
        f"'passport', 'P' || c_custkey, 'email', {_mail('c_custkey')})", "customer"),
    "location": _message(
        "hr.location", "c_custkey", "TIMESTAMP '2023-06-01' + to_seconds(c_custkey)",
        "CASE WHEN c_custkey % 5 = 0 THEN json_object('who', json_object('fullname', c_name), "
        f"'where', json_object('city', n_name, 'address', {STREET})) "
        f"ELSE json_object('fullname', c_name, 'city', n_name, 'address', {STREET}) END",
        "customer JOIN nation ON c_nationkey = n_nationkey"),
    "professional": _message(
        "hr.professional", "s_suppkey", "TIMESTAMP '2023-09-01' + to_seconds(s_suppkey)",
        "json_object('fullname', s_name, 'company', s_name || ' Trading', 'company address', n_name || ' 1', "
        "'company_telfnumber', '+49 ' || s_suppkey, 'company_email', 'info@s' || s_suppkey || '.example', "
        "'job', 'Analyst')", "supplier JOIN nation ON s_nationkey = n_nationkey"),
    "bank": _message(
        "hr.bank", "o_orderkey", "o_orderdate",
        "json_object('passport', ' p' || o_custkey || ' ', 'IBAN', CASE o_orderkey % 4 WHEN 0 THEN 'ES' "
        "WHEN 1 THEN 'FR' WHEN 2 THEN 'DE' ELSE 'XX' END || lpad((o_orderkey % 100)::VARCHAR, 2, '0') "
        "|| lpad(o_orderkey::VARCHAR, 18, '0'), 'salary', o_totalprice::DECIMAL(15,2)::VARCHAR)", "orders"),
    "net": _message(
        "hr.net", "event_id", "ts",
        "json_merge_patch(json_object('address', 'node ' || (event_id % 100), 'IPv4', '10.' || (event_id % 200) "
        "|| '.' || (user_id % 250) || '.' || (event_id % 7)), json_object("
        "'passport', CASE WHEN event_id % 8 IN (1, 5, 6, 7) THEN 'P' || user_id END, "
        f"'email', CASE WHEN event_id % 8 IN (0, 2, 4) THEN {_mail('user_id')} END, "
        "'phone', CASE WHEN event_id % 8 IN (2, 3) THEN '+34 ' || (user_id + 600000000) END))", "events"),
    "text": _message(
        "hr.text", "doc_id", "TIMESTAMP '2023-11-01' + to_seconds(doc_id)",
        "json_object('doc', doc_id, 'text', text, 'lang', lang, 'source', source)", "documents"),
    "chat": _message(
        "hr.chat", "(conv_id * 1000 + turn)", "TIMESTAMP '2023-12-01' + to_seconds(conv_id)",
        "json_object('turn', turn, 'role', role, 'text', text)", "conversations"),
}
KIND_VIEWS = tuple(V.KINDS)
PEOPLE = ("personal", "bank", "net")


def _norm(s: str) -> str:
    return f"trim(regexp_replace(lower({s}), '\\s+', ' ', 'g'))"


def _plain(s: str) -> str:
    """Letters and digits outside ASCII become word characters no pattern accepts, so ``\\b`` is Unicode-aware."""
    return f"regexp_replace({s}, '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{M}}\\p{{C}}]', '_', 'g')"


def _alias_values() -> str:
    rows = [(k, c, a) for k, fields in V.ALIASES.items() for c, aliases in fields.items() for a in aliases]
    rows += [("id", c, a) for c, aliases in V.IDENTIFIER_ALIASES.items() for a in aliases]
    rows += [("key", "fullname", a) for a in V.FULLNAME_ALIASES] + [("key", "dob", a) for a in V.BIRTH_ALIASES]
    return ", ".join(f"({_quoted(k)}, {_quoted(c)}, {_quoted(a)})" for k, c, a in rows)


def _signal(kind: str) -> str:
    test = f"regexp_matches(low, {_quoted('|'.join(V.KEYWORDS[kind]))})"
    if kind == "bank":
        test += f" OR regexp_matches(plain, '(?i){V.IBAN_PATTERN}') OR regexp_matches(plain, '(?i){V.SWIFT_PATTERN}')"
    if kind == "net":
        test += f" OR regexp_matches(plain, '{V.IPV4_PATTERN}')"
    return f"count(*) FILTER ({test})"


def _choice() -> str:
    best = f"greatest({', '.join('s_' + k for k in V.KINDS)})"
    return (f"CASE WHEN {best} = 0 THEN 'unknown' "
            + " ".join(f"WHEN s_{k} = {best} THEN '{k}'" for k in V.TIE_ORDER) + " END")


_COUNTRIES = "CASE {0} " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in V.IBAN_COUNTRIES.items()) + " END"
_FREE = ", ".join(_quoted(d) for d in V.FREE_MAIL_DOMAINS)
_SPLIT = "list_filter(string_split(lower({0}), '.'), lambda p: p NOT IN ('www', 'mail'))"


def _company(d: str) -> str:
    parts = _SPLIT.format(d)
    base = f"CASE WHEN len({parts}) >= 2 THEN {parts}[-2] ELSE {parts}[1] END"
    return (f"CASE WHEN {d} IS NOT NULL AND lower({d}) NOT IN ({_FREE}) THEN "
            f"nullif(upper(substr({base}, 1, 1)) || lower(substr({base}, 2)), '') END")


def _field(kind: str, name: str) -> str:
    return f"max(val) FILTER (kind = '{kind}' AND canon = '{name}')"


def base(*views: str) -> str:
    """Common table expressions from messages to folded profiles."""
    ids = ", ".join(f"nullif(max(val) FILTER (kind = 'id' AND canon = '{i}' AND is_text), '') AS {i}"
                    for i in V.IDENTIFIERS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}' AND useful) AS n_{k}" for k in V.KINDS)
    scores = ", ".join(f"coalesce(n_{k}, 0) + coalesce(g_{k}, 0) + {extra} AS s_{k}" for k, extra in (
        ("personal", "0"), ("location", "0"), ("professional", "0"),
        ("bank", "(f.iban IS NULL AND p.iban IS NOT NULL)::INT + (f.swift IS NULL AND p.swift IS NOT NULL)::INT"),
        ("net", "(f.ipv4 IS NULL AND p.ipv4 IS NOT NULL)::INT + (f.ipv6 IS NULL AND p.ipv6 IS NOT NULL)::INT")))
    return f"""
WITH RECURSIVE messages AS (
  SELECT *, topic || '_' || part || '_' || off AS raw_id, row(ts, topic, part, off) AS ord
  FROM ({' UNION ALL '.join(VIEWS[v] for v in views or KIND_VIEWS)})),
top AS (SELECT m.raw_id, e.id AS p1, 0 AS p2, e.key, e.type, e.value FROM messages m, json_each(m.payload::JSON) e),
entries AS (
  SELECT raw_id, 0 AS lvl, p1, p2, key, type, value FROM top
  UNION ALL
  SELECT t.raw_id, 1, t.p1, e.id, e.key, e.type, e.value
  FROM (SELECT * FROM top WHERE type = 'OBJECT') t, json_each(t.value) e),
strings AS (
  SELECT raw_id, lvl, p1, p2, 0 AS p3, value ->> '$' AS s FROM entries WHERE type = 'VARCHAR'
  UNION ALL
  SELECT a.raw_id, a.lvl, a.p1, a.p2, e.id, e.value ->> '$'
  FROM (SELECT * FROM entries WHERE type = 'ARRAY') a, json_each(a.value) e WHERE e.type = 'VARCHAR'),
marked AS (
  SELECT *, lower(s) AS low, {_plain('s')} AS plain, upper({_plain("replace(s, 'ß', 'ss')")}) AS up FROM strings),
found AS (
  SELECT *, nullif(regexp_extract(up, '{V.IBAN_PATTERN}'), '') AS iban,
    nullif(regexp_extract(up, '{V.SWIFT_PATTERN}'), '') AS swift,
    nullif(regexp_extract(plain, '{V.IPV4_PATTERN}'), '') AS ipv4,
    CASE WHEN contains(s, ':') AND regexp_matches(plain, '(?i){V.IPV6_PATTERN}') THEN {_norm('s')} END AS ipv6
  FROM marked),
patterns AS (
  SELECT raw_id, {', '.join(f"arg_min({c}, row(lvl, p1, p2, p3)) FILTER ({c} IS NOT NULL) AS {c}" for c in ('iban', 'swift', 'ipv4', 'ipv6'))},
    {', '.join(f"{_signal(k)} AS g_{k}" for k in V.KINDS)}
  FROM found GROUP BY raw_id),
aliases(kind, canon, alias) AS (VALUES {_alias_values()}),
hits AS (
  SELECT raw_id, kind, canon, type = 'VARCHAR' AS is_text,
    CASE WHEN type <> 'VARCHAR' THEN value::VARCHAR WHEN kind = 'bank' THEN trim(value ->> '$')
         ELSE {_norm("value ->> '$'")} END AS val
  FROM entries JOIN aliases ON lower(key) = alias
  QUALIFY row_number() OVER (PARTITION BY raw_id, kind, canon ORDER BY lvl, p1, p2) = 1),
useful AS (SELECT *, coalesce(val, 'null') NOT IN ('', '[]', 'null') AS useful FROM hits),
fields AS (
  SELECT raw_id, {counts}, {ids},
    {_field('bank', 'iban')} AS iban, {_field('bank', 'swift')} AS swift, {_field('net', 'ipv4')} AS ipv4,
    {_field('net', 'ipv6')} AS ipv6, {_field('net', 'domain')} AS domain,
    {_field('personal', 'fullname')} AS fullname, {_field('personal', 'email')} AS personal_email,
    {_field('location', 'address')} AS address, {_field('professional', 'company')} AS company,
    {_field('professional', 'salary')} AS salary,
    max(val) FILTER (kind = 'key' AND canon = 'fullname' AND is_text) AS key_name,
    max(val) FILTER (kind = 'key' AND canon = 'dob' AND is_text) AS key_dob
  FROM useful GROUP BY raw_id),
scored AS (
  SELECT m.*, f.* EXCLUDE (raw_id, iban, swift, ipv4, ipv6), coalesce(f.iban, p.iban) AS iban,
    coalesce(f.swift, p.swift) AS swift, coalesce(f.ipv4, p.ipv4) AS ipv4, coalesce(f.ipv6, p.ipv6) AS ipv6, {scores}
  FROM messages m LEFT JOIN fields f USING (raw_id) LEFT JOIN patterns p USING (raw_id)),
kinds AS (
  SELECT *, {_choice()} AS kind,
    coalesce('passport::' || passport, 'email::' || email, 'phone::' || phone,
             'fullnamedob::' || key_name || '::' || key_dob, 'rawid::' || raw_id) AS proposed_key,
    CASE WHEN contains(email, '@') THEN nullif(trim(substr(email, strpos(email, '@') + 1)), '') END AS mail_domain,
    upper(substr(iban, 1, 2)) AS cc,
    coalesce(n_bank, 0) + (iban IS NOT NULL)::INT + (swift IS NOT NULL)::INT AS any_bank,
    coalesce(n_net, 0) + (ipv4 IS NOT NULL)::INT + (ipv6 IS NOT NULL)::INT AS any_net
  FROM scored),
made AS (
  SELECT *, coalesce(mail_domain, domain) AS company_domain,
    kind = 'personal' AND n_personal > 0 AS own_personal, kind = 'location' AND n_location > 0 AS own_location,
    coalesce(n_professional, 0) > 0 AS own_professional, kind = 'bank' AND any_bank > 0 AS own_bank,
    kind = 'net' AND any_net > 0 AS own_net
  FROM kinds),
added AS (
  SELECT *, {_company('company_domain')} AS inferred,
    own_personal OR email IS NOT NULL OR phone IS NOT NULL AS has_personal,
    own_location OR cc IS NOT NULL AS has_location, own_bank AS has_bank,
    own_net OR mail_domain IS NOT NULL AS has_net,
    own_professional OR {_company('company_domain')} IS NOT NULL AS has_professional
  FROM made),
long AS (
  {' UNION ALL '.join(
      f"SELECT topic, raw_id, '{k}' AS contributed_kind, NOT own_{k} AS derived, "
      f"CASE WHEN kind = '{k}' THEN 1 ELSE {step} END AS step FROM added WHERE has_{k}"
      for k, step in (("personal", 3), ("location", 2), ("professional", 5), ("bank", 1), ("net", 4)))}),
live AS (SELECT * FROM added WHERE {' OR '.join('has_' + k for k in V.KINDS)})"""


def fold(key: str, source: str, observed: bool = False, out_key: str | None = None) -> str:
    """Profiles as scalar columns, newest block and identifier per group."""
    def block(kind: str, **fields: str) -> str:
        order = f"row(own_{kind}, ord)" if observed else "ord"
        packed = ", ".join(f"{n} := {e}" for n, e in fields.items())
        return f"arg_max(struct_pack({packed}), {order}) FILTER (has_{kind}) AS b_{kind}"
    blocks = ", ".join([
        block("personal", fullname="CASE WHEN own_personal THEN fullname END",
              personal_email="CASE WHEN own_personal THEN personal_email ELSE email END"),
        block("location", country_code="CASE WHEN NOT own_location THEN cc END",
              address="CASE WHEN own_location THEN address END"),
        block("professional", company="CASE WHEN own_professional THEN company ELSE inferred END",
              salary="CASE WHEN own_professional THEN salary END"),
        block("bank", iban="iban", swift="swift"),
        block("net", ipv4="CASE WHEN own_net THEN ipv4 END",
              domain="CASE WHEN own_net THEN domain ELSE mail_domain END")])
    ids = ", ".join(f"arg_max({i}, ord) FILTER ({i} IS NOT NULL) AS {i}" for i in V.IDENTIFIERS)
    names = ", ".join(f"CASE WHEN b_{k} IS NOT NULL THEN '{k}' END" for k in sorted(V.KINDS))
    return f"""
folded AS (SELECT {key} AS group_key, {ids}, {blocks}, min(ts) AS created_at, max(ts) AS updated_at
  {', ' + out_key if out_key else ''} FROM {source} GROUP BY ALL),
profiles AS (SELECT {'out_key' if out_key else 'group_key'} AS grouping_key, {', '.join(V.IDENTIFIERS)},
  array_to_string([{names}], ',') AS types, {' AND '.join(f'b_{k} IS NOT NULL' for k in V.KINDS)} AS is_complete,
  {' + '.join(f'(b_{k} IS NOT NULL)::BIGINT' for k in V.KINDS)} AS kinds,
  b_personal.fullname AS fullname, b_personal.personal_email AS personal_email,
  b_location.country_code AS country_code, b_location.address AS address,
  b_professional.company AS company, b_professional.salary AS salary, b_bank.iban AS iban, b_bank.swift AS swift,
  b_net.ipv4 AS ipv4, b_net.domain AS domain, created_at, updated_at,
  epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us FROM folded)"""


FLAT = ("grouping_key, " + ", ".join(V.IDENTIFIERS) + ", types, is_complete, fullname, personal_email, country_code, "
        "address, company, salary, iban, swift, ipv4, domain, created_us, updated_us")
PROFILES = base() + "," + fold("proposed_key", "live")


def _profiles(select: str) -> str:
    return f"{PROFILES} {select}"


# --- landing ---------------------------------------------------------------------
NET = f"WITH net AS (SELECT *, topic || '_' || part || '_' || off AS raw_id FROM ({VIEWS['net']}))"
ORACLE["landing_dedupe"] = (
    "SELECT 'hr.net' AS topic, CAST(event_id % 3 AS INTEGER) AS \"partition\", count(*) AS n, "
    "CAST(0 AS BIGINT) AS second_copies, CAST(sum(event_id // 3) AS BIGINT) AS offset_sum FROM events GROUP BY ALL")
_BAD = "event_id // 3 % 50 IN (0, 10, 20, 30)"
ORACLE["landing_metrics"] = f"""
SELECT count(*) AS consumed, count(*) FILTER (NOT ({_BAD}) AND event_id // 3 % 10 <> 1) AS inserted,
  count(*) FILTER ({_BAD}) AS errors, count(*) FILTER (event_id // 3 % 10 = 1) AS duplicates FROM events"""
ORACLE["dead_letter_rows"] = f"""
SELECT 'hr.net' AS topic, CAST(event_id % 3 AS INTEGER) AS "partition", count(*) AS n,
  CAST(sum(event_id // 3) AS BIGINT) AS offset_sum FROM events WHERE {_BAD} GROUP BY ALL"""
ORACLE["unprocessed_scan"] = (
    f"{NET} SELECT raw_id, CASE WHEN off % 4 = 1 THEN false END AS processed FROM net WHERE off % 4 <> 0")
ORACLE["unprocessed_ids"] = f"{NET} SELECT raw_id FROM net WHERE off % 4 <> 0"
ORACLE["mark_processed"] = (
    f"{NET} SELECT CASE WHEN part = 1 OR off % 4 = 0 THEN true WHEN off % 4 = 1 THEN false END AS processed, "
    "count(*) AS n FROM net GROUP BY ALL")
ORACLE["replay_reset"] = (
    f"{NET} SELECT CASE WHEN off % 4 <= 1 THEN false END AS processed, count(*) AS n FROM net GROUP BY ALL")
ORACLE["retention_window"] = (
    f"{NET} SELECT raw_id, epoch_us(ts) AS ts_us FROM net WHERE ts >= (SELECT max(ts) FROM net) - INTERVAL 1 HOUR")

# --- classification and extraction --------------------------------------------------
ALL = tuple(VIEWS)
_MESSAGES = ("WITH m AS (SELECT *, topic || '_' || part || '_' || off AS raw_id, json_keys(payload::JSON) AS keys FROM ("
             + " UNION ALL ".join(VIEWS[v] for v in KIND_VIEWS) + "))")
_ALL_MESSAGES = ("WITH m AS (SELECT *, topic || '_' || part || '_' || off AS raw_id, json_keys(payload::JSON) AS keys FROM ("
                 + " UNION ALL ".join(VIEWS.values()) + "))")


def _exact() -> str:
    parts = []
    for kind, needed, barred in V.EXACT_KEY_RULES:
        test = f"list_has_all(keys, {needed!r})"
        if barred:
            test += f" AND NOT list_contains(keys, '{barred}')"
        parts.append(f"WHEN {test} THEN '{kind}'")
    return f"CASE {' '.join(parts)} END"


for _kind, _fields in V.RECORD_FIELDS.items():
    _cols = ", ".join(
        f"coalesce(nullif(payload::JSON ->> '$.\"{key}\"', 'null'), '') AS \"{name}\"" for name, key in _fields.items())
    ORACLE[f"typed_{_kind}"] = f"{_MESSAGES} SELECT raw_id, {_cols} FROM m WHERE {_exact()} = '{_kind}'"
ORACLE["exact_kind_counts"] = (
    f"{_MESSAGES} SELECT coalesce({_exact()}, 'unknown') AS kind, count(*) AS n FROM m GROUP BY ALL")
ORACLE["scored_kind_counts"] = f"{base(*ALL)} SELECT topic, kind, count(*) AS n FROM kinds GROUP BY ALL"
ORACLE["block_fields"] = f"""{base(*ALL)},
named AS (
  SELECT DISTINCT raw_id, kind, canon AS field FROM useful WHERE useful AND kind NOT IN ('id', 'key')
  UNION SELECT raw_id, 'bank', 'iban' FROM patterns WHERE iban IS NOT NULL
  UNION SELECT raw_id, 'bank', 'swift' FROM patterns WHERE swift IS NOT NULL
  UNION SELECT raw_id, 'net', 'ipv4' FROM patterns WHERE ipv4 IS NOT NULL
  UNION SELECT raw_id, 'net', 'ipv6' FROM patterns WHERE ipv6 IS NOT NULL)
SELECT m.topic, n.kind, n.field, count(*) AS n FROM named n JOIN messages m USING (raw_id) GROUP BY ALL"""
ORACLE["light_unknown_block"] = (
    "SELECT 'hr.text_' || (doc_id % 3) || '_' || (doc_id // 3) AS raw_id, 'doc,lang,source,text' AS names, "
    "doc_id::VARCHAR AS doc, lang FROM documents")
ORACLE["extract_patterns"] = (
    f"{base('text')} SELECT raw_id, iban, swift, ipv4 FROM messages LEFT JOIN patterns USING (raw_id)")
ORACLE["identifiers"] = f"{base()} SELECT raw_id, {', '.join(V.IDENTIFIERS)} FROM kinds"
ORACLE["grouping_key"] = f"{base()} SELECT raw_id, proposed_key FROM kinds"

# --- derivation -----------------------------------------------------------------------
ORACLE["derive_location"] = (
    f"{base('bank')} SELECT raw_id, cc AS country_code, {_COUNTRIES.format('cc')} AS country "
    "FROM added WHERE has_location AND NOT own_location")
ORACLE["derive_personal"] = f"{base('net')} SELECT raw_id, email, phone FROM added WHERE has_personal AND NOT own_personal"
ORACLE["derive_net"] = (
    f"{base('personal', 'net')} SELECT raw_id, mail_domain AS domain FROM added WHERE has_net AND NOT own_net")
ORACLE["derive_professional"] = (
    f"{base('personal', 'net')} SELECT raw_id, inferred AS company, 'true' AS _inferred "
    "FROM added WHERE has_professional AND NOT own_professional")
ORACLE["contributions"] = (
    f"{base(*ALL)} SELECT topic, contributed_kind, derived, step, count(*) AS n FROM long GROUP BY ALL")
ORACLE["batch_metrics"] = f"""{base(*ALL)}
SELECT count(*) AS read, CAST(sum({' + '.join(f'has_{k}::INT' for k in V.KINDS)}) AS BIGINT) AS upserts,
  {', '.join(f"count(*) FILTER (has_{k}) AS {k}" for k in V.KINDS)},
  count(*) FILTER (kind = 'unknown') AS skipped_unknown,
  count(*) FILTER (kind <> 'unknown' AND NOT CASE kind {' '.join(f"WHEN '{k}' THEN own_{k}" for k in V.KINDS)} END)
    AS skipped_empty FROM added"""

# --- fold and resolution ----------------------------------------------------------------
ORACLE["profile_completeness"] = (
    f"{base(*ALL)},{fold('proposed_key', 'live')} "
    "SELECT kinds, is_complete, count(*) AS n FROM profiles GROUP BY ALL")
ORACLE["profile_fold"] = _profiles(f"SELECT {FLAT} FROM profiles")
ORACLE["profile_fold_observed"] = f"{base()},{fold('proposed_key', 'live', observed=True)} SELECT {FLAT} FROM profiles"
_TOKENS = ", ".join(f"'{i}=' || {i}" for i in V.IDENTIFIERS)
_RESOLVE = f""",
tokens AS (
  SELECT *, list_filter([{_TOKENS}, CASE WHEN proposed_key LIKE 'fullnamedob::%' THEN 'key=' || proposed_key END],
                        lambda t: t IS NOT NULL) AS ts_list FROM added),
linked AS (SELECT *, CASE WHEN len(ts_list) = 0 THEN ['key=' || proposed_key] ELSE ts_list END AS toks FROM tokens),
edges AS (
  SELECT DISTINCT toks[1] AS u, unnest(toks[2:]) AS v FROM linked WHERE len(toks) > 1),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (
  SELECT u AS token, u AS other FROM both_ways
  UNION
  SELECT r.token, b.v FROM reach r JOIN both_ways b ON r.other = b.u),
labels AS (SELECT token, min(other) AS label FROM reach GROUP BY token),
grouped AS (
  SELECT l.*, coalesce(b.label, l.toks[1]) AS label,
    {' + '.join(f"({i} IS NOT NULL)::INT * {1 << (4 - n)}" for n, i in enumerate(V.IDENTIFIERS))} AS presence
  FROM linked l LEFT JOIN labels b ON b.token = l.toks[1]
  WHERE {' OR '.join('has_' + k for k in V.KINDS)}),
heads AS (SELECT label, arg_min(proposed_key, row(31 - presence, ord)) AS out_key FROM grouped GROUP BY label),
resolved AS (SELECT g.*, h.out_key FROM grouped g JOIN heads h USING (label))"""
RESOLVED = base(*PEOPLE) + _RESOLVE
ORACLE["resolve_all_views"] = f"{base(*ALL)}{_RESOLVE},{fold('label', 'resolved', out_key='out_key')} SELECT {FLAT} FROM profiles"
ORACLE["resolve_components"] = f"{RESOLVED},{fold('label', 'resolved', out_key='out_key')} SELECT {FLAT} FROM profiles"
ORACLE["resolve_mapping"] = (
    f"{RESOLVED} SELECT DISTINCT proposed_key, out_key AS grouping_key FROM resolved WHERE proposed_key <> out_key")
ORACLE["stream_profiles"] = ORACLE["resolve_components"]
_FILL = ("fullname, personal_email", "country_code, address", "company, salary", "iban, swift", "ipv4, domain")
_KIND_FLAGS = {k: f"contains(types, '{k}')" for k in V.KINDS}
ORACLE["merge_groups"] = _profiles(f""",
mapping AS (
  SELECT s.grouping_key AS source_key, t.grouping_key AS target_key FROM profiles s JOIN profiles t ON s.email = t.email
  WHERE s.grouping_key LIKE 'email::%' AND t.grouping_key LIKE 'passport::%'),
moved AS (
  SELECT p.*, m.target_key IS NOT NULL AS is_source, coalesce(m.target_key, p.grouping_key) AS into_key
  FROM profiles p LEFT JOIN mapping m ON m.source_key = p.grouping_key),
filled AS (
  SELECT into_key AS grouping_key,
    {', '.join(f"arg_min({i}, row(is_source, grouping_key)) FILTER ({i} IS NOT NULL) AS {i}" for i in V.IDENTIFIERS)},
    {', '.join(f"arg_min(row({c}), row(is_source, grouping_key)) FILTER ({_KIND_FLAGS[k]}) AS b_{k}"
               for k, c in zip(V.KINDS, _FILL))},
    arg_min(created_us, row(is_source, grouping_key)) AS created_us, max(updated_us) AS updated_us
  FROM moved GROUP BY into_key)
SELECT grouping_key, {', '.join(V.IDENTIFIERS)},
  array_to_string([{', '.join(f"CASE WHEN b_{k} IS NOT NULL THEN '{k}' END" for k in sorted(V.KINDS))}], ',') AS types,
  {' AND '.join(f'b_{k} IS NOT NULL' for k in V.KINDS)} AS is_complete,
  {', '.join(f"b_{k}[{n + 1}] AS {c}" for k, cols in zip(V.KINDS, _FILL) for n, c in enumerate(cols.split(', ')))},
  created_us, updated_us FROM filled""")
ORACLE["refine_profiles"] = _profiles(
    "SELECT grouping_key, types, is_complete, length(grouping_key) % 2 = 0 AND types <> "
    "CASE WHEN contains(types, 'bank') THEN 'bank' ELSE '' END OR length(grouping_key) % 2 = 1 AS changed FROM profiles")

# --- export and publish -------------------------------------------------------------------
_SINCE = "TIMESTAMP '2024-01-30 12:00:00'"
ORACLE["export_keyset"] = _profiles(
    f"SELECT grouping_key, updated_us FROM profiles WHERE is_complete AND (updated_at > {_SINCE} OR "
    f"(updated_at = {_SINCE} AND grouping_key > 'passport::p5')) ORDER BY updated_at, grouping_key LIMIT 100")
ORACLE["export_skew"] = _profiles(
    f"SELECT grouping_key, updated_us FROM profiles WHERE is_complete AND updated_at >= {_SINCE} - INTERVAL 1 DAY "
    "ORDER BY updated_at, grouping_key LIMIT 100")
ORACLE["export_gate"] = _profiles(
    "SELECT count(*) FILTER (is_complete) AS passed, count(*) FILTER (NOT is_complete) AS skipped FROM profiles")
ORACLE["export_checkpoint"] = _profiles(
    "SELECT updated_us AS ts_us, grouping_key AS last_id FROM (SELECT * FROM profiles ORDER BY updated_at, grouping_key "
    "LIMIT 1000) ORDER BY updated_at DESC, grouping_key DESC LIMIT 1")
ORACLE["persons_rows"] = _profiles(
    f"SELECT grouping_key, {', '.join(V.IDENTIFIERS)}, created_us, CASE WHEN length(grouping_key) % 3 > 0 THEN updated_us "
    "ELSE epoch_us(TIMESTAMP '2024-02-01') END AS updated_us FROM profiles")
_PER_KIND = " UNION ALL ".join(f"SELECT '{k}' AS kind, updated_us, is_complete FROM profiles WHERE {_KIND_FLAGS[k]}"
                               for k in V.KINDS)
ORACLE["child_rows"] = _profiles(
    f"SELECT kind, count(*) AS n, max(updated_us) AS max_us FROM ({_PER_KIND}) GROUP BY ALL")
ORACLE["export_rows_per_table"] = _profiles(
    f"SELECT kind AS \"table\", count(*) AS rows, max(updated_us) AS max_us FROM ({_PER_KIND} UNION ALL "
    "SELECT 'persons', updated_us, is_complete FROM profiles) WHERE is_complete GROUP BY ALL")
ORACLE["wide_bank"] = _profiles(f"SELECT grouping_key AS person_id, iban, swift FROM profiles WHERE {_KIND_FLAGS['bank']}")
ORACLE["wide_professional"] = f"""{base()},
newest AS (
  SELECT proposed_key AS person_id, arg_max(struct_pack(
    company := CASE WHEN own_professional THEN company ELSE inferred END,
    inferred := CASE WHEN NOT own_professional THEN 'true' END,
    salary := CASE WHEN own_professional THEN salary END), ord) FILTER (has_professional) AS b
  FROM live GROUP BY ALL)
SELECT person_id, b.company AS company, b.inferred AS inferred, b.salary AS salary FROM newest WHERE b IS NOT NULL"""
_HALVES = """WITH rows AS (SELECT *, (SELECT count(*) FROM customer) AS total FROM customer),
t AS (SELECT 'passport::p' || c_custkey AS grouping_key, c_name AS passport,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS email,
  CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2023-01-01' END AS created_at, TIMESTAMP '2023-02-01' AS updated_at
  FROM rows WHERE c_custkey < total * 2 / 3),
s AS (SELECT 'passport::p' || c_custkey AS grouping_key,
  CASE WHEN c_custkey % 3 <> 0 THEN 'new ' || c_custkey END AS passport,
  CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey::VARCHAR END AS email, TIMESTAMP '2024-01-01' AS created_at,
  TIMESTAMP '2024-02-01' AS updated_at FROM rows WHERE c_custkey >= total / 3)"""
for _policy, _rule in (("replace", "CASE WHEN s.grouping_key IS NOT NULL THEN s.{0} ELSE t.{0} END"),
                       ("coalesce_new", "coalesce(s.{0}, t.{0})"), ("target_wins", "coalesce(t.{0}, s.{0})")):
    ORACLE[f"upsert_{_policy}"] = (
        f"{_HALVES} SELECT coalesce(t.grouping_key, s.grouping_key) AS grouping_key, "
        f"{_rule.format('passport')} AS passport, {_rule.format('email')} AS email, "
        "epoch_us(coalesce(t.created_at, s.created_at)) AS created_us, "
        "epoch_us(coalesce(s.updated_at, t.updated_at)) AS updated_us "
        "FROM t FULL OUTER JOIN s ON t.grouping_key = s.grouping_key")

# --- reports -----------------------------------------------------------------------------------
ORACLE["pipeline_stats"] = _profiles("""
SELECT *, profiles_total - profiles_complete AS profiles_pending, raw_processed * 100.0::DOUBLE / raw_total AS processed_pct,
  profiles_complete * 100.0::DOUBLE / profiles_total AS complete_pct
FROM (SELECT count(*) AS raw_total, count(*) FILTER (off % 4 = 0) AS raw_processed,
        count(*) FILTER (off % 4 <> 0) AS raw_pending FROM messages WHERE topic = 'hr.net'),
     (SELECT count(*) AS profiles_total, count(*) FILTER (is_complete) AS profiles_complete FROM profiles)""")
ORACLE["kind_frequency"] = _profiles(
    "SELECT kind, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM profiles) AS share_pct FROM "
    "(SELECT unnest(string_split(types, ',')) AS kind FROM profiles) GROUP BY kind")
ORACLE["kind_distribution"] = _profiles("SELECT kinds, count(*) AS n FROM profiles GROUP BY ALL")
ORACLE["all_kinds_count"] = _profiles("SELECT count(*) FILTER (is_complete) AS n FROM profiles")
ORACLE["global_completeness"] = _profiles(
    "SELECT received, needed, received * 100.0::DOUBLE / needed AS completeness_pct FROM "
    "(SELECT CAST(sum(kinds) AS BIGINT) AS received, count(*) * 5 AS needed FROM profiles)")
ORACLE["field_frequency"] = (
    f"{_ALL_MESSAGES} SELECT field, count(*) AS n FROM (SELECT unnest(keys) AS field FROM m) GROUP BY ALL")
ORACLE["count_by_field"] = (
    f"{_ALL_MESSAGES} SELECT CAST(payload::JSON -> '$.lang' AS VARCHAR) AS value, count(*) AS n FROM m GROUP BY ALL")
ORACLE["landing_stats"] = (
    f"{_ALL_MESSAGES} SELECT coalesce({_exact()}, 'unknown') AS kind, count(*) AS n FROM m GROUP BY ALL ORDER BY n DESC, kind")
ORACLE["topic_totals"] = (
    f"{_MESSAGES} SELECT topic, CAST(sum(e) AS BIGINT) AS messages FROM "
    "(SELECT topic, part, max(off) + 1 AS e FROM m GROUP BY ALL) GROUP BY topic")
ORACLE["consumer_lag"] = f"""{_MESSAGES}
SELECT topic, part AS "partition", max(off) + 1 AS end_offset, count(*) FILTER (done) AS committed,
  max(off) + 1 - count(*) FILTER (done) AS lag
FROM (SELECT *, topic IN ('hr.bank', 'hr.net') AND NOT (topic = 'hr.net' AND part = 2) AND off % 100 < 90 AS done FROM m)
GROUP BY ALL"""
ORACLE["stage_reconciliation"] = f"""{_MESSAGES}
SELECT topic, part AS "partition", count(*) AS published, count(*) FILTER (NOT (part = 1 AND off % 10 = 3)) AS landed,
  count(*) = count(*) FILTER (NOT (part = 1 AND off % 10 = 3)) AS matches FROM m GROUP BY ALL"""
ORACLE["progress_snapshots"] = """
WITH days AS (SELECT ts::DATE AS day, count(*) AS processed, CAST(sum(event_id) AS BIGINT) AS pending FROM events GROUP BY ALL),
moves AS (SELECT *, processed - lag(processed) OVER (ORDER BY day) AS delta,
  (day - lag(day) OVER (ORDER BY day)) * 86400.0::DOUBLE AS secs FROM days)
SELECT day::VARCHAR AS day, processed, delta, round(delta / secs, 9) AS speed,
  round(CASE WHEN delta / secs > 0 THEN pending / (delta / secs) END, 3) AS eta_seconds FROM moves"""
ORACLE["latest_rows"] = (
    f"{_MESSAGES} SELECT raw_id, epoch_us(ts) AS ts_us FROM m ORDER BY ts DESC, topic DESC, part DESC, off DESC LIMIT 50")
ORACLE["sample_profiles"] = _profiles(
    "SELECT kinds, grouping_key FROM profiles QUALIFY row_number() OVER (PARTITION BY kinds ORDER BY grouping_key) <= 2")
ORACLE["find_by_identifier"] = _profiles(f"SELECT {FLAT} FROM profiles WHERE passport = 'p7'")
ORACLE["nonempty_blocks"] = _profiles(f"SELECT grouping_key FROM profiles WHERE {_KIND_FLAGS['net']}")

# --- streams ---------------------------------------------------------------------------------------
ORACLE["stream_landing"] = f"""
SELECT 'hr.net' AS topic, CAST(event_id % 3 AS INTEGER) AS "partition", count(*) AS n,
  CAST(sum(event_id // 3) AS BIGINT) AS offset_sum FROM events WHERE NOT ({_BAD}) GROUP BY ALL"""
ORACLE["stream_kind_counts"] = ORACLE["exact_kind_counts"]
ORACLE["stream_counts_replay"] = ORACLE["exact_kind_counts"]
ORACLE["stream_profiles_two_sources"] = ORACLE["stream_profiles"]
ORACLE["stream_landing_replay"] = f"""
SELECT 'hr.net' AS topic, CAST(event_id % 3 AS INTEGER) AS "partition", CASE WHEN {_BAD} THEN 'dead' ELSE 'landed' END AS state,
  count(*) AS n, CAST(sum(event_id // 3) AS BIGINT) AS offset_sum, CAST(0 AS BIGINT) AS changed FROM events GROUP BY ALL"""
ORACLE["publish_late_profiles"] = (
    "SELECT 'passport::p' || c_custkey AS grouping_key, CAST(c_custkey % 2 AS BIGINT) AS export FROM customer "
    "WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
ORACLE["typed_repeated_keys"] = (
    "SELECT 'twice_' || c_custkey AS raw_id, 'B' || c_custkey AS passport, 'Y' || c_custkey AS \"IBAN\", '1' AS salary FROM customer")
ORACLE["profile_fold_no_timestamp"] = f"""WITH timed AS (
  SELECT o_custkey, CASE WHEN o_orderkey // 3 % 2 = 1 THEN epoch_us(o_orderdate::TIMESTAMP) END AS us FROM orders)
SELECT 'passport::p' || o_custkey AS grouping_key, 'bank,location,professional' AS types, min(us) AS created_us, max(us) AS updated_us
FROM timed GROUP BY o_custkey"""
ORACLE["merge_groups_chain"] = """WITH kept AS (
  SELECT c_custkey AS k, least((c_custkey // 3) * 3 + 2, (SELECT max(c_custkey) FROM customer)) AS survivor FROM customer)
SELECT 'passport::p' || survivor AS grouping_key, 'p' || survivor AS passport,
  epoch_us(TIMESTAMP '2023-01-01' + to_seconds(survivor)) AS created_us,
  epoch_us(TIMESTAMP '2023-01-01' + to_seconds(max(k))) AS updated_us FROM kept GROUP BY survivor"""
for _kind, _columns in (("personal", "fullname, personal_email AS email"), ("location", "address, country_code"), ("net", "domain, ipv4")):
    ORACLE[f"wide_{_kind}"] = _profiles(f"SELECT grouping_key AS person_id, {_columns} FROM profiles WHERE {_KIND_FLAGS[_kind]}")
ORACLE["wide_nested"] = (
    "SELECT 'k' || c_custkey AS person_id, 'c' AS company, CAST(c_custkey AS BIGINT) AS location_a_b_c_d_e, 'x' AS location_f FROM customer")
ORACLE["wide_upsert"] = _profiles(
    f"SELECT grouping_key, {', '.join(V.IDENTIFIERS)}, iban, swift FROM profiles")
ORACLE["consumer_lag_total"] = (
    f"{_MESSAGES}, ends AS (SELECT topic, part, max(off) + 1 AS e, count(*) FILTER (topic = 'hr.bank') AS c FROM m GROUP BY ALL) "
    "SELECT topic, CAST(sum(e - c) AS BIGINT) AS lag FROM ends GROUP BY topic")
ORACLE["first_rows"] = f"{_MESSAGES} SELECT raw_id, epoch_us(ts) AS ts_us FROM m ORDER BY topic, part, off LIMIT 50"
ORACLE["sample_messages"] = (
    f"{_ALL_MESSAGES} SELECT kind, raw_id FROM (SELECT *, coalesce({_exact()}, 'unknown') AS kind FROM m) "
    "QUALIFY row_number() OVER (PARTITION BY kind ORDER BY topic, part, off) <= 2")
ORACLE["strict_parse"] = (
    f"{_ALL_MESSAGES} SELECT topic, count(*) AS n, CAST(sum(len(keys)) AS BIGINT) AS fields FROM m GROUP BY ALL")
_TELLING = {"personal": "personal_email", "location": "country_code", "professional": "company", "bank": "iban", "net": "ipv4"}
ORACLE["child_payloads"] = _profiles(" UNION ALL ".join(
    f"SELECT '{k}' AS kind, grouping_key, {c} AS value FROM profiles WHERE {_KIND_FLAGS[k]}" for k, c in _TELLING.items()))
ORACLE["publish_key_fallback"] = _profiles(
    "SELECT * FROM (SELECT coalesce(CASE WHEN length(grouping_key) % 2 = 1 THEN grouping_key END, 'passport::' || passport, "
    "'email::' || email, 'phone::' || phone) AS grouping_key, passport, email, phone FROM profiles) WHERE grouping_key IS NOT NULL")
ORACLE["wide_type_change"] = """WITH c AS (SELECT c_custkey AS k FROM customer),
stored AS (
  SELECT 0 AS e, k, k::VARCHAR AS score, '9007199254740993' AS large, 'true' AS sure, NULL AS added_late FROM c
  UNION ALL
  SELECT 1, k, CASE WHEN k % 3 >= 1 THEN k || '.5' ELSE k || '.0' END, CASE WHEN k % 3 >= 1 THEN '0.5' ELSE '9007199254740993' END,
    'true', NULL FROM c
  UNION ALL
  SELECT 2, k, CASE k % 3 WHEN 2 THEN 'n/a' WHEN 1 THEN k || '.5' ELSE k || '.0' END,
    CASE WHEN k % 3 >= 1 THEN '0.5' ELSE '9007199254740993' END, CASE k % 3 WHEN 2 THEN '1' ELSE 'true' END,
    CASE k % 3 WHEN 2 THEN '1,x' END FROM c)
SELECT CAST(e AS BIGINT) AS export, 'k' || k AS person_id, score, CASE e WHEN 0 THEN 'bigint' WHEN 1 THEN 'double' ELSE 'string' END AS score_type,
  large, CASE e WHEN 0 THEN 'bigint' ELSE 'string' END AS large_type, sure, CASE WHEN e < 2 THEN 'boolean' ELSE 'string' END AS sure_type,
  'c' || k AS company, 'string' AS company_type, added_late, CASE e WHEN 2 THEN 'string' END AS added_late_type FROM stored"""
ORACLE["export_partial_rewrite"] = _profiles(
    "SELECT grouping_key, passport, CASE grouping_key WHEN 'passport::p7' THEN 'changed' ELSE phone END AS phone, "
    "count(*) OVER () AS first_export, CAST(1 AS BIGINT) AS second_export, true AS one_bucket_a_table FROM profiles "
    "WHERE grouping_key LIKE 'passport::%'")
_LATE = base("personal", "bank")
ORACLE["export_counters"] = f"""{_LATE},
late AS (SELECT *, topic = 'hr.bank' AND regexp_matches(passport, '[13579]$') AS second FROM live),
states AS (
  SELECT e.export, proposed_key, max(second::INT) AS newest, {', '.join(f'bool_or(has_{k}) AS {k}' for k in V.KINDS)}
  FROM late, (VALUES (0), (1)) e(export) WHERE e.export = 1 OR NOT second GROUP BY ALL),
changed AS (SELECT * FROM states WHERE newest = export),
ready AS (SELECT *, personal AND bank AS complete FROM changed)
SELECT CAST(export AS BIGINT) AS export, count(*) AS changed, count(*) FILTER (complete) AS published,
  count(*) FILTER (complete) AS persons, {', '.join(f"count(*) FILTER (complete AND {k}) AS {t}" for k, t in V.CHILD_TABLES.items())},
  true AS timed FROM ready GROUP BY ALL"""
ORACLE["stream_landing_counters"] = f"""
SELECT CAST(2 AS BIGINT) AS batches, count(*) + count(*) FILTER (event_id // 3 % 3 = 0) AS consumed,
  count(*) FILTER ({_BAD}) + count(*) FILTER ({_BAD} AND event_id // 3 % 3 = 0) AS errors,
  count(*) FILTER (NOT ({_BAD})) AS landed, count(*) FILTER ({_BAD}) AS dead,
  count(*) FILTER (NOT ({_BAD}) AND event_id // 3 % 3 = 0) AS duplicates, true AS timed FROM events"""
_MADE = (f"CAST(sum({' + '.join(f'has_{k}::INT' for k in V.KINDS)}) AS BIGINT) AS upserts, "
         f"{', '.join(f'count(*) FILTER (has_{k}) AS {k}' for k in V.KINDS)}, count(*) FILTER (kind = 'unknown') AS skipped_unknown, "
         f"count(*) FILTER (kind <> 'unknown' AND NOT CASE kind {' '.join(f"WHEN '{k}' THEN own_{k}" for k in V.KINDS)} END) AS skipped_empty")
ORACLE["stream_profile_counters"] = f"""{base("personal", "net")}
SELECT CAST((topic = 'hr.personal')::INT AS BIGINT) AS batch, count(*) + any_value(bad) AS consumed, any_value(bad) AS errors,
  count(*) AS read, {_MADE}, any_value(merged) AS merges, true AS timed
FROM (SELECT *, CASE topic WHEN 'hr.net' THEN (SELECT count(*) FROM events WHERE {_BAD}) ELSE 0 END AS bad,
        CASE topic WHEN 'hr.personal' THEN (
          SELECT count(DISTINCT user_id) FROM events JOIN customer ON user_id = c_custkey
          WHERE NOT ({_BAD}) AND event_id % 8 IN (0, 2, 4)) ELSE 0 END AS merged
      FROM added WHERE NOT (topic = 'hr.net' AND off % 50 IN (0, 10, 20, 30))) GROUP BY topic"""
ORACLE["hub_identifiers"] = """WITH tokens AS (
  SELECT unnest(['passport=p' || user_id, 'phone=+34 ' || CASE WHEN event_id % 3 = 0 THEN '000' ELSE event_id::VARCHAR END,
    CASE WHEN event_id % 20 = 0 THEN 'email=desk' || (event_id % 40) || '@acme.com' END]) AS token FROM events),
counted AS (SELECT token, count(*) AS n FROM tokens WHERE token IS NOT NULL GROUP BY token),
whole AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS "of" FROM counted)
SELECT token, n, "of" FROM whole WHERE n * 250 > "of\""""
ORACLE["extract_addresses"] = (
    f"{base('text', 'chat')} SELECT raw_id, iban, swift, ipv4, md5(ipv6) AS ipv6_md5 FROM scored WHERE coalesce(iban, swift, ipv4, ipv6) IS NOT NULL")
_TIMES = "[epoch_us(TIMESTAMP '2024-01-10 03:04:05'), epoch_us(TIMESTAMP '2024-01-10 01:04:05'), epoch_us(TIMESTAMP '2024-01-10 03:04:05'), NULL]"
ORACLE["persons_text_times"] = _profiles(
    "SELECT grouping_key, coalesce(created, updated) AS created_us, updated AS updated_us FROM (SELECT grouping_key, "
    f"{_TIMES}[length(grouping_key) % 4 + 2] AS created, coalesce({_TIMES}[length(grouping_key) % 4 + 1], "
    "epoch_us(TIMESTAMP '2024-02-01')) AS updated FROM profiles)")
ORACLE["first_hundred_fields"] = (
    f"{_ALL_MESSAGES}, oldest AS (SELECT *, row_number() OVER (ORDER BY ts, topic, part, off) AS place FROM m QUALIFY place <= 100) "
    "SELECT 'field' AS part, item, count(*) AS n FROM (SELECT unnest(keys) AS item FROM oldest) GROUP BY item UNION ALL "
    "SELECT 'sample', raw_id, place FROM oldest WHERE place <= 5")
ORACLE["stream_kind_sets"] = f"""{RESOLVED},{fold('label', 'resolved', out_key='out_key')}
SELECT 'kinds' AS report, kinds::VARCHAR AS item, count(*) AS n FROM profiles GROUP BY ALL
UNION ALL SELECT 'kind', unnest(string_split(types, ',')) AS item, count(*) FROM profiles GROUP BY item
UNION ALL SELECT 'profiles', 'all', count(*) FROM profiles
UNION ALL SELECT 'profiles', 'complete', count(*) FILTER (is_complete) FROM profiles
UNION ALL SELECT 'completeness', 'received', CAST(sum(kinds) AS BIGINT) FROM profiles
UNION ALL SELECT 'completeness', 'needed', count(*) * 5 FROM profiles"""
ORACLE["landing_expiry"] = f"""
SELECT ts::DATE::VARCHAR AS day, CASE WHEN {_BAD} THEN 'dead' ELSE 'landed' END AS state, count(*) AS n FROM events
WHERE ts::DATE >= (SELECT max(ts::DATE) FROM events WHERE NOT ({_BAD})) - 10 GROUP BY ALL"""
ORACLE["stream_progress"] = """
SELECT CAST(3 AS BIGINT) AS batches, count(*) FILTER (event_id // 3 % 4 < 3) AS rows, count(*) FILTER (event_id // 3 % 4 = 3) AS pending,
  true AS timed FROM events"""
