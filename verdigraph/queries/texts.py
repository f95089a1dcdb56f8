"""Queries over text extraction, on texts made from the star-schema tables and on the documents."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.functions.text import CITATION_PATTERNS, PARALLEL_ORDER, PII_PATTERNS, REPORTERS, canonical_reporter, case_id, pii_left, preferred_reporter, redact_pii, short_label, statute_id
from verdigraph.operators.extract import citation_parts, documents_graph, documents_graph_auto, extract_citations, extract_entities, extract_obligations, personal_spans, standard_form
from verdigraph.plugins import PluginLoader, analyze
from verdigraph.queries.tables import read
from verdigraph.sources.documents import audit_chain, dot, entity_counts, report, verify_chain
from verdigraph.sources.graph import read_graphml
from verdigraph.sources.graphml import write_graphml
from verdigraph.sources.scratch import scratch, settle

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short opinion for each order: a case citation and a statute, set apart by semicolons."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("; Acme"), k % 97, F.lit(" v. Bolt"), F.col("o_custkey") % 89, F.lit(", "), k % 500 + 1, F.lit(" U.S. "), k % 900 + 100, F.lit(" ("), k % 70 + 1950, F.lit("); see "), k % 50 + 1, F.lit(" U.S.C. § "), k % 3000 + 1, F.lit(" and "), k % 40 + 1, F.lit(" CFR "), k % 1600 + 1, F.lit("."), k % 9, F.lit(";"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


_O = """o AS (SELECT o_orderkey AS k, 'Acme' || o_orderkey % 97 AS a, 'Bolt' || o_custkey % 89 AS b, CAST(o_orderkey % 500 + 1 AS VARCHAR) AS vol, CAST(o_orderkey % 900 + 100 AS VARCHAR) AS page,
CAST(o_orderkey % 70 + 1950 AS VARCHAR) AS y, CAST(o_orderkey % 50 + 1 AS VARCHAR) AS t, CAST(o_orderkey % 3000 + 1 AS VARCHAR) AS s, CAST(o_orderkey % 40 + 1 AS VARCHAR) AS ct, (o_orderkey % 1600 + 1) || '.' || o_orderkey % 9 AS cs FROM orders)"""


@query(f"""WITH {_O} SELECT k AS doc_id, 'case' AS type, a || ' v. ' || b || ', ' || vol || ' U.S. ' || page || ' (' || y || ')' AS raw FROM o
UNION ALL SELECT k, 'case', a || ' v. ' || b FROM o UNION ALL SELECT k, 'statute', t || ' U.S.C. § ' || s FROM o UNION ALL SELECT k, 'statute', ct || ' CFR ' || cs FROM o""")
def extract_case_and_statute_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of all patterns: a full case citation also matches the simple one."""
    return extract_citations(opinions(spark, sf_dir)).select("doc_id", "type", "raw")


@query(f"""WITH {_O} SELECT k AS doc_id, a || ' v. ' || b || ', ' || vol || ' U.S. ' || page AS standard_form FROM o UNION ALL SELECT k, a || ' v. ' || b FROM o
UNION ALL SELECT k, t || ' U.S.C. § ' || s FROM o UNION ALL SELECT k, ct || ' U.S.C. § ' || cs FROM o""")
def normalize_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standard_form(extract_citations(opinions(spark, sf_dir))).select("doc_id", "standard_form")


@query(f"""WITH {_O} SELECT k AS doc_id, CAST(0.95 AS DOUBLE) AS confidence, a AS plaintiff, page, y AS year, '' AS title FROM o UNION ALL SELECT k, 0.85, a, '', '', '' FROM o
UNION ALL SELECT k, 0.9, '', '', '', t FROM o UNION ALL SELECT k, 0.9, '', '', '', ct FROM o""")
def citation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence by pattern and the parts of each citation."""
    parts = citation_parts(extract_citations(opinions(spark, sf_dir)))
    return parts.select("doc_id", "confidence", *[F.coalesce(c, F.lit("")).alias(c) for c in ("plaintiff", "page", "year", "title")])


@query(f"""WITH {_O} SELECT k AS doc_id, 'case::' || a || '_v_' || b || '_' || y AS id, 'case' AS kind, CAST(y AS INT) AS year, 0 AS n_refs, 0 AS n_tags FROM o
UNION ALL SELECT k, 'statute::' || t || '_USC_' || s, 'statute', 0, 1, 0 FROM o UNION ALL SELECT k, 'doc::US-CA', 'document', 0, 0, 1 FROM o""")
def doc_to_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = documents_graph(opinions(spark, sf_dir))
    return nodes.select("doc_id", "id", "kind", F.coalesce("year", F.lit(0)).alias("year"), F.size("statute_refs").alias("n_refs"), F.size("pii_tags").alias("n_tags"))


def _re2(pattern: str) -> str:
    """A citation pattern for DuckDB, whose words are ASCII unless told otherwise."""
    return pattern.replace(r"\w", r"\p{L}\p{N}_").replace("'", "''")


_CITING = "lang || ', that ' || coalesce(source, 'web') || ' & Sons v. Roe, ' || (doc_id % 500 + 1) || ' F.2d ' || (n_chars % 900 + 1) || ' (' || (doc_id % 60 + 1950) || '), in ' || (doc_id % 50 + 1) || ' U.S.C. § ' || (doc_id % 3000 + 1) || '(a); '"


@query("WITH d AS (SELECT doc_id, " + _CITING + " || text || ' so ' || " + _CITING + " || text AS t FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS type, unnest(regexp_extract_all(t, '{_re2(p)}', 0, 'i')) AS raw, CAST({score} AS DOUBLE) AS confidence FROM d" for kind, p, score in CITATION_PATTERNS))
def citations_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations set before and into every document, whole: parties are as long as the words around them."""
    k = F.col("doc_id")
    said = F.concat("lang", F.lit(", that "), F.coalesce("source", F.lit("web")), F.lit(" & Sons v. Roe, "), k % 500 + 1, F.lit(" F.2d "), F.col("n_chars") % 900 + 1, F.lit(" ("), k % 60 + 1950, F.lit("), in "), k % 50 + 1, F.lit(" U.S.C. § "), k % 3000 + 1, F.lit("(a); "))
    text = F.concat(said, "text", F.lit(" so "), said, "text")
    return extract_citations(read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))).select("doc_id", "type", "raw", "confidence")


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinions that name three cases, the first one twice where the order number is even."""
    k = F.col("o_orderkey")
    again = F.when(k % 2 == 0, F.concat(F.lit("; Acme"), k % 97, F.lit(" v. Bolt; "))).otherwise("; ")
    text = F.concat(F.lit("; Acme"), k % 97, F.lit(" v. Bolt; Cole"), k % 7, F.lit(" v. Dunn; Eden v. Frye"), k % 5, again, k % 50 + 1, F.lit(" U.S.C. § 7;"))
    return read(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("text"))


_B = "o AS (SELECT o_orderkey AS k, 'case::Acme' || o_orderkey % 97 || '_v_Bolt' AS a, 'case::Cole' || o_orderkey % 7 || '_v_Dunn' AS b, 'case::Eden_v_Frye' || o_orderkey % 5 AS c, 'statute::' || (o_orderkey % 50 + 1) || '_USC_7' AS s FROM orders)"
_BRIEF_EDGES = f"""WITH {_B} SELECT k AS doc_id, a AS src, s AS dst, 'cites' AS label FROM o UNION ALL SELECT k, b, s, 'cites' FROM o UNION ALL SELECT k, c, s, 'cites' FROM o
UNION ALL SELECT k, a, b, 'persuasive_relation' FROM o UNION ALL SELECT k, a, c, 'persuasive_relation' FROM o UNION ALL SELECT k, a, a, 'persuasive_relation' FROM o WHERE k % 2 = 0"""


@query(_BRIEF_EDGES)
def doc_to_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case cites every statute; the first case is persuasive for the others, and for itself if named again."""
    return documents_graph(briefs(spark, sf_dir))[1].select("doc_id", "src", "dst", "label")


@query(_BRIEF_EDGES)
def doc_to_graph_auto_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_graph_auto(briefs(spark, sf_dir))[1].select("doc_id", "src", "dst", "label")


@query(f"""WITH {_O} SELECT 'case' AS kind, 2 * count(*) AS n FROM o UNION ALL SELECT 'statute', count(DISTINCT (k, t || '_USC_' || s)) + sum(CASE WHEN t = ct AND s = cs THEN 0 ELSE 1 END)::BIGINT FROM o UNION ALL SELECT 'document', count(*) FROM o""")
def doc_to_graph_auto_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extractor also finds the case without its year, and the regulation."""
    return documents_graph_auto(opinions(spark, sf_dir))[0].groupBy("kind").agg(F.count("*").alias("n"))


_DUTY_VERBS = ["shall", "must", "is required to", "has a duty to", "are required to", "is obligated to", "is responsible for", "owes", "has an obligation to"]


@query("SELECT o_orderkey AS doc_id, 'The tenant' AS bearer, 'pay ' || (o_orderkey % 900 + 1) || ' crowns' AS duty FROM orders UNION ALL SELECT o_orderkey, 'Landlords', 'give notice' FROM orders WHERE o_orderkey % 3 = 0")
def extract_duties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of words by which a duty is said."""
    k = F.col("o_orderkey")
    verb = F.array(*map(F.lit, _DUTY_VERBS))[(F.col("o_custkey") % 9).cast("int")]
    text = F.concat(F.lit("The tenant "), verb, F.lit(" pay "), k % 900 + 1, F.lit(" crowns."), F.when(k % 3 == 0, " Landlords are required to give notice.").otherwise(" Nothing else"))
    return extract_obligations(read(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("text"))).select("doc_id", "bearer", "duty")


_ROMAN = "['I', 'II', 'IV', 'V', 'IX', 'XIV']"


@query(f"""WITH c AS (SELECT o_orderkey AS k, {_ROMAN}[1 + o_orderkey % 6] AS a, CAST(o_custkey % 12 + 1 AS VARCHAR) AS s, {_ROMAN}[1 + o_custkey % 6] AS m FROM orders)
SELECT k AS doc_id, 'U.S. Const. art. ' || a || ', § ' || s AS raw, a AS article_or_amendment, s AS section, CAST(0.95 AS DOUBLE) AS confidence FROM c UNION ALL SELECT k, 'US Const amend ' || m, m, '', 0.95 FROM c""")
def extract_constitution_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    roman = F.array(*map(F.lit, ["I", "II", "IV", "V", "IX", "XIV"]))
    text = F.concat(F.lit("Under U.S. Const. art. "), roman[(k % 6).cast("int")], F.lit(", § "), c % 12 + 1, F.lit("; and by US Const amend "), roman[(c % 6).cast("int")], F.lit("; so held."))
    found = citation_parts(extract_citations(read(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("text"))))
    return found.select("doc_id", "raw", "article_or_amendment", F.coalesce("section", F.lit("")).alias("section"), "confidence")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.lit("on 2019-03-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(" Jane Doe"), F.when(k % 2 == 0, " paid $1,250.50 under Section 12").otherwise(" left"), F.lit(", 7 USC 42."))
    return read(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("text"))


@query("""SELECT 'DATE' AS entity_group, count(*) AS n FROM orders UNION ALL SELECT 'PERSON', count(*) FROM orders UNION ALL SELECT 'STATUTE', count(*) + count(*) FILTER (WHERE o_orderkey % 2 = 0) FROM orders UNION ALL SELECT 'MONEY', count(*) FROM orders WHERE o_orderkey % 2 = 0""")
def entity_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_counts(extract_entities(_mixed(spark, sf_dir)))


@query("""WITH m AS (SELECT o_orderkey AS k, '2019-03-' || lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') AS d, CASE WHEN o_orderkey % 2 = 0 THEN 32 ELSE 5 END AS w FROM orders)
SELECT k AS doc_id, 'DATE' AS entity_group, d AS word, 3 AS start FROM m UNION ALL SELECT k, 'PERSON', 'Jane Doe', 14 FROM m UNION ALL SELECT k, 'STATUTE', '7 USC 42', 22 + w + 2 FROM m
UNION ALL SELECT k, 'MONEY', '$1,250.50', 28 FROM m WHERE w = 32 UNION ALL SELECT k, 'STATUTE', 'Section 12', 44 FROM m WHERE w = 32""")
def extract_entities_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping spans are settled by score, then by order of the patterns."""
    return extract_entities(_mixed(spark, sf_dir)).select("doc_id", "entity_group", "word", "start")


@query("SELECT o_orderkey AS doc_id, 'Jane Doe' AS word, 14 AS start, 22 AS stop, 'pii_basic' AS tag FROM orders")
def personal_data_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a person is named."""
    return personal_spans(_mixed(spark, sf_dir)).withColumnRenamed("end", "stop")


@query()
def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the documents themselves."""
    return entity_counts(extract_entities(read(spark, sf_dir, "documents")))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\b(19|20)\\d{2}-((0[1-9])|(1[0-2]))-(([0-2][0-9])|(3[01]))\\b', 'YYYY-MM-DD', 'g'),
'(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}', '[redacted_email]', 'g'), '\\b(?:\\+1[-.\\s]?)?(?:\\(\\d{3}\\)|\\d{3})[-.\\s]?\\d{3}[-.\\s]?\\d{4}\\b', '[redacted_phone]', 'g'), '\\b\\d{5}(?:-\\d{4})?\\b', '[redacted_zip]', 'g')) AS digest FROM documents""")
def redact_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of the patterns, that both engines read alike, over all documents."""
    chosen = [p for p in PII_PATTERNS if p[0] in ("dob_iso", "email", "phone", "zip")]
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(redact_pii(F.col("text"), chosen).cast("binary")).alias("digest"))


@query("SELECT count(*) AS n, count(text) AS texts, CAST(0 AS BIGINT) AS blocked FROM documents")
def redaction_leaves_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After redaction no pattern matches, or the text would not be let in."""
    kept = read(spark, sf_dir, "documents").select(redact_pii(F.col("text")).alias("text"))
    return kept.agg(F.count("*").alias("n"), F.count("text").alias("texts"), F.count_if(pii_left(F.col("text"))).alias("blocked"))


@query()
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight patterns over all documents: held against Python's own regular expressions in the tests."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(redact_pii(F.col("text")).cast("binary")).alias("digest"))


_PEOPLE = "p AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey % 899 + 1 AS VARCHAR), 3, '0') AS a, lpad(CAST(o_custkey % 99 + 1 AS VARCHAR), 2, '0') AS b, lpad(CAST(o_orderkey % 9999 + 1 AS VARCHAR), 4, '0') AS c FROM orders WHERE o_orderkey % 899 + 1 <> 666)"


@query(f"""WITH {_PEOPLE} SELECT k AS id, 'id XXX-XX-XXXX, born MM/DD/YYYY or YYYY-MM-DD, at [redacted_address], [redacted_zip]; [redacted_email], [redacted_phone], licence [redacted_dl].' AS masked,
'to ' || sha256('a' || k || '@x.org') || ' and ' || sha256('b' || c || '@y.net') || '!' AS hashed, 'to  and !' AS dropped FROM p""")
def redact_each_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each order in which every pattern matches, masked; and two addresses, each hashed by itself or dropped."""
    k = F.col("o_orderkey")

    def digits(x: Column, n: int) -> Column:
        return F.lpad(x.cast("string"), n, "0")

    a, b, c = digits(k % 899 + 1, 3), digits(F.col("o_custkey") % 99 + 1, 2), digits(k % 9999 + 1, 4)
    text = F.concat(F.lit("id "), a, F.lit("-"), b, F.lit("-"), c, F.lit(", born 0"), k % 9 + 1, F.lit("/"), k % 9 + 10, F.lit("/19"), k % 89 + 10, F.lit(" or 20"), k % 89 + 10, F.lit("-1"), k % 3, F.lit("-0"), k % 9 + 1, F.lit(", at "), k % 900 + 1, F.lit(" Elm Grove Road, "), digits(k % 99999, 5), F.lit("; user."), k, F.lit("@mail.example.com, 415-555-"), c, F.lit(", licence AB"), digits(k % 999999, 6), F.lit("."))
    two = F.concat(F.lit("to a"), k, F.lit("@x.org and b"), c, F.lit("@y.net!"))
    email = [p for p in PII_PATTERNS if p[0] == "email"]
    people = read(spark, sf_dir, "orders").filter(k % 899 + 1 != 666)
    return people.select(k.alias("id"), redact_pii(text).alias("masked"), redact_pii(two, [(*p, "hash") for p in email]).alias("hashed"), redact_pii(two, [(*p, "drop") for p in email]).alias("dropped"))


_SPELT = [x for key, written, _ in REPORTERS for x in ((key, written), (key, written.replace(" ", "")), (key, f" {written.lower().rstrip('.')} "))] + [(None, "Zzz"), (None, "F. 9d"), (None, "")]
_SPELT_SQL = ", ".join(f"({i}, {'NULL' if k is None else repr(k)}, {w!r})" for i, (k, w) in enumerate(_SPELT))


@query(f"SELECT s.written, s.reporter, count(*) AS n FROM lineitem JOIN (VALUES {_SPELT_SQL}) s(i, reporter, written) ON s.i = (l_orderkey * 7 + l_linenumber) % {len(_SPELT)} GROUP BY ALL")
def canonical_reporters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reporter in three spellings, and what is none."""
    at = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % len(_SPELT)).cast("int")
    lines = read(spark, sf_dir, "lineitem").select(F.array(*[F.lit(w) for _, w in _SPELT])[at].alias("written"))
    return lines.select("written", canonical_reporter(F.col("written")).alias("reporter")).groupBy("written", "reporter").agg(F.count("*").alias("n"))


_ORDER_SQL = ", ".join(f"('{k}', {i})" for i, k in enumerate(PARALLEL_ORDER))
_KEYS_SQL = ", ".join(f"({i}, '{k}')" for i, (k, *_) in enumerate(REPORTERS))


@query(f"""WITH k(i, key) AS (VALUES {_KEYS_SQL}), o(key, place) AS (VALUES {_ORDER_SQL}), c AS (SELECT o_orderkey, k.key FROM orders JOIN k ON k.i IN (o_orderkey % 33, o_custkey % 33, (o_orderkey + o_custkey) % 33))
SELECT o_orderkey AS id, arg_min(c.key, o.place) AS reporter FROM c JOIN o ON o.key = c.key GROUP BY 1""")
def parallel_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parallel citations each: the reporter that comes first in the order stands for all."""
    keys = F.array(*[F.lit(k) for k, *_ in REPORTERS])
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    cited = F.transform(F.array(a % 33, b % 33, (a + b) % 33), lambda i: keys[i.cast("int")])
    return read(spark, sf_dir, "orders").select(a.alias("id"), preferred_reporter(cited).alias("reporter"))


@query("SELECT p_partkey AS part, 'case::' || replace(p_name, ' ', '_') || '_v_' || replace(p_type, ' ', '_') || CASE WHEN p_size % 2 = 0 THEN '_' || (1900 + p_size) ELSE '' END AS id, 'statute::' || p_size || '_USC_' || p_partkey AS sid FROM part")
def normalized_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.col("p_size") % 2 == 0, (F.col("p_size") + 1900).cast("string"))
    spaced = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t ")), F.lit(" "))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), case_id(spaced, F.col("p_type"), year).alias("id"), statute_id(F.concat(F.lit(" "), "p_size"), F.col("p_partkey").cast("string")).alias("sid"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 79) || '…' ELSE text END AS label FROM documents")
def safe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", short_label(F.col("text")).alias("label"))


@query("""WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS log, event_id AS seq, event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c(log, seq, payload, n, prev_hash, hash) AS (SELECT log, seq, payload, n, '', sha256('{"payload":"' || payload || '","prev_hash":""}') FROM o WHERE n = 1
UNION ALL SELECT o.log, o.seq, o.payload, o.n, c.hash, sha256('{"payload":"' || o.payload || '","prev_hash":"' || c.hash || '"}') FROM c JOIN o ON o.log = c.log AND o.n = c.n + 1)
SELECT log, seq, payload, prev_hash, hash FROM c""")
def audit_hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("log"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    return audit_chain(e)


_DEALT = [("they offered", 2), ("which we accept", 3), ("in exchange for goods", 5), ("and breached it", 7)]


@query("WITH d AS (SELECT doc_id, concat_ws(' ', text, " + ", ".join(f"CASE WHEN doc_id % {n} <> 0 THEN '{said}' END" for said, n in _DEALT) + r""") AS t FROM documents),
f AS (SELECT CAST(doc_id AS VARCHAR) AS scope, regexp_matches(t, '(?i)\boffer(?:s|ed)?\b') AS o, regexp_matches(t, '(?i)\baccept(?:s|ed|ance)?\b') AS a, regexp_matches(t, '(?i)\b(?:consideration|in exchange for|pays?|paid)\b') AS c, regexp_matches(t, '(?i)\b(?:breach(?:es|ed)?|fail(?:s|ed) to (?:perform|deliver|pay))\b') AS b FROM d),
s AS (SELECT scope, 'offer_made' AS statement, 'OFFER' AS basis FROM f WHERE o UNION ALL SELECT scope, 'offer_accepted', 'ACCEPTANCE' FROM f WHERE a UNION ALL SELECT scope, 'consideration_given', 'CONSIDERATION' FROM f WHERE c UNION ALL SELECT scope, 'obligation_unmet', 'BREACH' FROM f WHERE b
UNION ALL SELECT scope, 'contract_formed', 'Restatement (Second) of Contracts § 17' FROM f WHERE o AND a AND c UNION ALL SELECT scope, 'damages_due', 'Hadley v. Baxendale' FROM f WHERE o AND a AND c AND b)
SELECT scope, statement, basis, CAST(0.9 AS DOUBLE) AS confidence FROM s""")
def plugin_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample plugin over all documents, some with words of a deal after them: original facts, and those derived by its rules with their authority."""
    k = F.col("doc_id")
    text = F.concat_ws(" ", "text", *[F.when(k % n != 0, said) for said, n in _DEALT])
    plugin = PluginLoader(str(Path(__file__).parents[2] / "plugins")).load("contract_law")
    found = analyze(read(spark, sf_dir, "documents").select("doc_id", text.alias("text")), plugin, {"jurisdiction": "US-CA"})
    original = found["original_facts"].select("scope", "statement", F.col("entity_type").alias("basis"), "confidence")
    return original.unionByName(found["derived_facts"].select("scope", "statement", F.col("rule_authority").alias("basis"), "confidence"))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS log, event_id AS seq, lag(event_id % 83 = 5) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events)
SELECT log, seq, 'hash' AS fault FROM e WHERE seq % 97 = 0 AND seq % 83 <> 5 UNION ALL SELECT log, seq, 'link' FROM e WHERE after AND seq % 83 <> 5""")
def audit_chain_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of hash chains in which some payloads were changed and some entries taken out, where: by ranges, whatever a log's length."""
    written = audit_hash_chain(spark, sf_dir)
    changed = written.withColumn("payload", F.when(F.col("seq") % 97 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return verify_chain(changed.filter("seq % 83 <> 5"))


@query("""SELECT value FROM (SELECT 'digraph {' AS value UNION ALL SELECT '}' UNION ALL SELECT '  "' || n_name || '" [label="' || n_nationkey || '"];' FROM nation UNION ALL SELECT '  "' || n_name || '" -> "' || r_name || '" [label="in"];' FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def graphviz_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    nodes = n.select(F.col("n_name").alias("id"), F.col("n_nationkey").cast("string").alias("label"))
    edges = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"), F.lit("in").alias("label"))
    return dot(nodes, edges)


@query("""SELECT '{"citations":["' || c || '"],"conclusions":[{"id":"x","confidence":0.5}],"doc_id":' || o_orderkey || ',"entities":{"DATE":1}}' AS value FROM (SELECT o_orderkey, (o_orderkey % 50 + 1) || ' USC 7' AS c FROM orders)""")
def document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line for each document."""
    k = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    e = k.withColumn("entity_group", F.lit("DATE"))
    c = k.withColumn("raw", F.concat(F.col("doc_id") % 50 + 1, F.lit(" USC 7")))
    return report(e, c, k.select("doc_id", F.lit("x").alias("id"), F.lit(0.5).alias("confidence")))


def _label_counts(rows: DataFrame, number: Column) -> DataFrame:
    """(label, n, n_u, n_v, total of number) of rows(u, v, labels): an end is one row with a count for each label, so labels are never rows and an end is shuffled once for all of them."""
    names = sorted(r["label"] for r in rows.select(F.explode("labels").alias("label")).distinct().collect())
    has = [F.array_contains("labels", k) for k in names]
    by_u = rows.groupBy("u").agg(*[x for i, h in enumerate(has) for x in (F.count_if(h).alias(f"n{i}"), F.sum(F.when(h, number)).alias(f"t{i}"))])
    by_v = rows.groupBy("v").agg(*[F.count_if(h).alias(f"n{i}") for i, h in enumerate(has)])
    met_u = by_u.agg(*[x for i in range(len(names)) for x in (F.sum(f"n{i}").alias(f"n{i}"), F.count_if(F.col(f"n{i}") > 0).alias(f"u{i}"), F.sum(f"t{i}").alias(f"t{i}"))])
    met_v = by_v.agg(*[F.count_if(F.col(f"n{i}") > 0).alias(f"v{i}") for i in range(len(names))])
    each = [F.struct(F.lit(k).alias("label"), F.col(f"n{i}").alias("n"), F.col(f"u{i}").alias("n_u"), F.col(f"v{i}").alias("n_v"), F.col(f"t{i}").alias("total")) for i, k in enumerate(names)]
    typed = F.array(*each).cast("array<struct<label:string,n:bigint,n_u:bigint,n_v:bigint,total:bigint>>")
    return met_u.crossJoin(met_v).select(F.inline(typed))


@query("""WITH e AS (SELECT 'o:' || l_orderkey AS u, 'p:' || l_partkey AS v, bool_or(l_discount >= 0.05) AS same_issue, bool_or(l_returnflag = 'R') AS controlling_relation FROM lineitem GROUP BY l_orderkey, l_partkey),
l AS (SELECT 'cites' AS label, u, v FROM e UNION ALL SELECT 'same_issue', u, v FROM e WHERE same_issue UNION ALL SELECT 'controlling_relation', u, v FROM e WHERE controlling_relation UNION ALL SELECT 'large', 'p:' || p_partkey, '' FROM part WHERE p_size > 25)
SELECT label, count(*) AS n, count(DISTINCT u) AS n_u, count(DISTINCT v) AS n_v, sum(CAST(substr(u, 3) AS HUGEINT) * 7 + CAST(coalesce(nullif(substr(v, 3), ''), '0') AS HUGEINT))::BIGINT AS total FROM l GROUP BY label""")
def graphml_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and citations of them as GraphML files, read again: zero, "No" and missing values are no labels."""
    path = f"{scratch(spark)}/graphml-{uuid.uuid4().hex}"
    lines = read(spark, sf_dir, "lineitem")
    last = lines.groupBy("l_orderkey", "l_partkey").agg(F.bool_or(F.col("l_discount") >= 0.05).alias("same"), F.bool_or(F.col("l_returnflag") == "R").alias("ruled"))
    # Written once: write_graphml() goes over the edges for their keys and again for themselves.
    edges = settle(last, "cited").select(F.concat(F.lit("o:"), "l_orderkey").alias("src"), F.concat(F.lit("p:"), "l_partkey").alias("dst"), F.create_map(F.lit("cites"), F.lit("1"), F.lit("same_issue"), F.when(F.col("same"), "true").otherwise("No"), F.lit("controlling_relation"), F.when(F.col("ruled"), "yes")).alias("attrs"))
    nodes = read(spark, sf_dir, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.create_map(F.lit("large"), F.when(F.col("p_size") > 25, "x").otherwise("0")).alias("attrs"))
    write_graphml(nodes, edges, path)
    g = read_graphml(spark, path)
    rows = g.edges.unionByName(g.nodes.select(F.col("id").alias("u"), F.lit("").alias("v"), "labels"))
    number = lambda c: F.coalesce(F.substr(F.col(c), F.lit(3)).try_cast("long"), F.lit(0))
    return _label_counts(rows, number("u") * 7 + number("v"))
