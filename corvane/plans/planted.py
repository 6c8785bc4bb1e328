"""Detection over planted texts: every customer gets a sentence with one value of a known kind, so SQL knows the spans.

A template is (class, words before, value, words behind); the value is an expression that Spark SQL and the oracle both read: ``k`` is
the customer's number as text, ``n`` that number modulo 90, two digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import forms, logs, names, normalise, patterns, secrets, writing
from corvane.plans.registry import query, table

PATTERNS = [
    ("mail", "write to ", "concat('user', k, '@mail.org')", " now"), ("url", "see ", "concat('https://h.example/p', k)", " now"), ("iban", "pay ", "'DE89 3704 0044 0532 0130 00'", " now"), ("vat", "VAT ", "'DE123456789'", " now"), ("ip", "from ", "concat('8.8.', n, '.4')", " now"),
    ("ip", "host ip-", "concat('8-8-', n, '-4')", " now"), ("ip", "at ", "concat('2a00:1450:4001:', n, '::200e')", " now"), ("mac", "mac ", "'0a1b2c3d4e5f'", " now"), ("mac", "nic ", "'0A:1B:2C:3D:4E:5F'", " now"), ("phone", "call ", "concat('+49 89 12345', n)", " now"),
    ("phone", "Tel. ", "concat('089 / 12345', n)", " now"), ("phone", "dial ", "concat('0049 89 12345', n)", " now"), ("bic", "BIC: ", "'COBADEFFXXX'", " now"), ("bic", "pay to ", "'DEUTDEFF500'", " now"), ("register", "Handelsregister ", "concat('HRB 123', n)", " now"),
    ("tax", "Steuernummer: ", "'12/345/67890'", " now"), ("tax", "Tax ID ", "'12 345 678 901'", " now"), ("host", "see ", "concat('intra', n, '.acme.de')", " now"), ("token", "key ", "concat('AKIA', 'ABCDEFGHIJKLMN', n)", " now"), ("home_path", "in ", "concat('/home/user', k)", " now"),
    (None, "version is ", "concat('8.8.1.', n)", " now"), (None, "costs ", "concat('0.1234', n)", " EUR/h"), (None, "read ", "concat('page', n, '.md')", " now"), (None, "the ", "'INVENTAR'", " now"),
]
NAMES = [
    ("person", "Dear ", "'Anna Berg'", ",\nhow are you"), ("person", "Best regards,\n", "'Eva Lind'", "\n"), ("person", "seen by Dr. ", "'Max Roth'", " today"), ("company", "we met ", "concat('Berg Werke GmbH')", " today"), ("place", "Ort: ", "'Ulm'", "\n"),
    ("person", "From: ", "'Ines Wolf'", " <x>"), ("person", "On Monday last week, ", "'Karl Dorn'", " wrote:"), ("person", "[10:20] ", "'Olga Stein'", ": yes"), ("place", "at ", "'Birkenweg 12'", " today"), ("person", "the ", "'Hans von Arnim'", " file"), ("person", "see ", "'J. Kern'", " today"),
    ("person", "x;CN=", "'Paul Brand'", ";"), ("person", "then by ", "'T A U B E'", " there"), ("person", "Thanks, ", "'Petra'", " and"), ("person", "the ", "'John F. Kern'", " file"), ("person", "assigned to: ", "'Karla Dorn'", ";"), ("company", "Kunde: ", "'nordwind'", "\n"), (None, "The ", "'Monday'", " file"),
]
SECRETS = [
    ("secret", "password = '", "concat('x8FqzL', n, 'Kd')", "'"), ("header", "Authorization: Bearer ", "concat('abcdef', k, 'xyz')", ""), ("userinfo", "https://bob:", "concat('Hunter', n)", "@x.org/"), ("flag", "mysql -u root -p", "concat('S3cret', n)", " db"), ("prose", "the password for the admin is ", "concat('Tr0ub4dor', n)", "!"),
    ("table", "user|password\n---|---\nbob|", "concat('Xy12ab!', n)", ""), ("xml", "<db.password>", "concat('Xy12ab!', n)", "</db.password>"), ("hash", "root:", "'$6$saltsalt$hashhashhash'", ""), ("token", "key ", "concat('AKIAABCDEFGHIJKLMN', n)", " ok"), (None, "PASSWORD=", "'${X}'", ""), (None, "mkdir -p ", "concat('/var/tmp/x', n)", ""),
]
LOGS = [
    ("user", "login: user=", "concat('anna', k)", " ok"), ("user", "Failed password for invalid user ", "concat('bob', n)", " port"), ("user", "session opened for user ", "concat('eva', n)", " by"), ("user", "seen ", "concat('ACME', '\\\\', 'lind', n)", " in"), ("user", "run -u ", "concat('otto', n)", " now"), ("host", "hostname=", "concat('db', k)", " up"),
    ("host", "on ", "concat('app', n, '.corp')", " now"), ("host", "from host ", "concat('web', n)", " now"), ("ip", "from ", "concat('8.8.4.', n)", " now"), ("mail", "to ", "concat('x', k, '@mail.org')", " now"), (None, "session opened for user ", "'root'", " by"),
]


def _lit(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def planted_sql(templates: list[tuple]) -> str:
    """SQL for c_custkey, cls, a, v, z: class, words before, value, words behind."""
    case = lambda at, shown: "CASE CAST(c_custkey % " + str(len(templates)) + " AS INT) " + " ".join(f"WHEN {i} THEN {shown(t[at])}" for i, t in enumerate(templates)) + " END"
    rows = "(SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k, lpad(CAST(c_custkey % 90 AS VARCHAR), 2, '1') AS n FROM customer)"
    return f"(SELECT c_custkey, {case(0, _lit)} AS cls, {case(1, _lit)} AS a, {case(2, str)} AS v, {case(3, _lit)} AS z FROM {rows})".replace("'\\\\'", "'\\'")


def planted(spark: SparkSession, sf_dir: str, templates: list[tuple]) -> DataFrame:
    """c_custkey, text."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("k"), F.lpad((F.col("c_custkey") % 90).cast("string"), 2, "1").alias("n"))
    at = (F.col("c_custkey") % len(templates)).cast("int")
    text = F.coalesce(*[F.when(at == i, F.concat(F.lit(a), F.expr(v), F.lit(z))) for i, (_, a, v, z) in enumerate(templates)])
    return c.select("c_custkey", text.alias("text"))


def _spans_sql(templates: list[tuple]) -> str:
    return f"SELECT c_custkey, cls, len(a) AS start, len(a) + len(v) AS \"end\", v AS form FROM {planted_sql(templates)} WHERE cls IS NOT NULL"


def _spans(rows: DataFrame, spans) -> DataFrame:
    s = rows.select("c_custkey", F.explode(spans).alias("s"))
    return s.select("c_custkey", "s.cls", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.col("s.form").alias("form"))


@query(_spans_sql(PATTERNS))
def planted_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every structured pattern, and what must not be one: versions, prices, file names, plain capitals."""
    return _spans(planted(spark, sf_dir, PATTERNS), patterns.spans(F.col("text")))


@query(f"SELECT c_custkey, CASE WHEN cls IS NULL THEN a || v || z ELSE a || '[' || cls || '-' || substr(sha256(CASE WHEN cls = 'phone' THEN regexp_replace(regexp_replace(v, '[^0-9]', '', 'g'), '^00', '') WHEN cls IN ('iban', 'vat', 'mac') THEN regexp_replace(upper(v), '[^0-9A-Z]', '', 'g') ELSE lower(v) END), 1, 10) || ']' || z END AS redacted FROM {planted_sql(PATTERNS)}")
def planted_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts with stable tokens of canonical values."""
    return planted(spark, sf_dir, PATTERNS).select("c_custkey", patterns.redacted(F.col("text")).alias("redacted"))


@query(_spans_sql(NAMES))
def planted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for persons, companies and places by the rules."""
    return _spans(planted(spark, sf_dir, NAMES), names.candidate_spans(F.col("text")))


@query(_spans_sql(SECRETS).replace("v AS form", "a || '[secret]' || z AS form"))
def planted_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by class, and the text without them."""
    rows = planted(spark, sf_dir, SECRETS).select("c_custkey", F.explode(secrets.secret_spans(F.col("text"))).alias("s"), secrets.without_secrets(F.col("text")).alias("form"))
    return rows.select("c_custkey", "s.cls", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "form")


@query(f"SELECT c_custkey, CASE WHEN cls IS NULL THEN a || v || z ELSE a || '[' || cls || '-' || substr(sha256(lower(v)), 1, 8) || ']' || z END AS wiped FROM {planted_sql(LOGS)}")
def planted_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with users, hosts and addresses as tokens."""
    return planted(spark, sf_dir, LOGS).select("c_custkey", logs.wiped_log(F.col("text")).alias("wiped"))


CLAIMS = [
    ("price,high", "It costs ", "concat(n, ' EUR')", "."), ("-", "See ", "'2026-01-02 at 10:30'", "."), ("identifier,high", "Use ", "concat('s', n, '.large.2')", " now."), ("api-path,high", "Call ", "concat('GET /v1/', n, '/x')", " today."), ("number,medium", "There are ", "n", " nodes."), ("number,high", "The total is ", "n", " nodes."),
    ("version,medium", "Take ", "concat('1.2.', n)", " today."), ("negative,high", "It is ", "'not'", " there."), ("url,low", "See ", "concat('https://a.b/', k)", "."), ("price+number,high", "The price is ", "n", "."), ("-", "Host ", "concat('10.0.0.', n)", " is CUST-Q7M4."), ("number,high", "We have ", "concat(n, ' per month')", "."),
]


@query(f"SELECT c_custkey, replace(split_part(cls, ',', 1), '+', ',') AS kinds, split_part(cls, ',', 2) AS risk, a || v || z AS sentence FROM {planted_sql(CLAIMS)} WHERE cls <> '-'")
def planted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with a claim, its kinds and its risk."""
    c = planted(spark, sf_dir, CLAIMS).select("c_custkey", F.explode(writing.claims_of(F.col("text"))).alias("c"))
    return c.select("c_custkey", "c.kinds", "c.risk", "c.sentence")


FORMS = [("N-1", "Müller Werke"), ("N-2", "Berg"), ("N-3", "Groß & Klein")]
FORM_TEXTS = [("N-1", "of ", "'Mueller-Werke'", " and"), ("N-1", "of ", "'MÜLLER WERKE'", " and"), ("N-2", "of ", "'Bergs'", " and"), ("N-2", "of ", "'berg'", "-side"), ("N-3", "of ", "'gross & klein'", " and"), (None, "of ", "'Bergung'", " and"), (None, "of ", "'Heidelberg'", " and")]


@query(_spans_sql(FORM_TEXTS))
def planted_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered names in their written variants, at word boundaries only."""
    return _spans(planted(spark, sf_dir, FORM_TEXTS), forms.form_spans(F.col("text"), FORMS))


ESCAPES = [
    ("ö", "M", "'%C3%B6'", "we"), ("ü", "M", "'%FC'", "ller"), (None, "a", "'%00'", "b"), ("ä", "B", "'\\\\u00e4'", "r"), (None, "x", "'\\\\u0000'", "y"), ("ö", "M", "'=C3=B6'", "we"), (None, "a", "'=3D'", "1"), ("é", "caf", "'\\\\xe9'", "s"), ("ü", "", "concat('\\\\', chr(39), 'fc')", "ber"), ("ö", "", "'\\\\u246?'", "x"),
    ("&", "a ", "'&amp;'", " b"), ("", "ab", "'­'", "cd"), (" ", "a", "' '", "b"),
]


@query(f"SELECT c_custkey, a || coalesce(cls, v) || z AS normal FROM {planted_sql(ESCAPES).replace(chr(92) * 2, chr(92))}")
def planted_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes decoded in context; control characters never are."""
    return planted(spark, sf_dir, ESCAPES).select("c_custkey", normalise.normalised(F.col("text")).alias("normal"))
