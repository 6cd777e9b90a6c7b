"""Inputs derived from the given tables.

No given table holds postings, model answers or run logs, so they are derived by the SQL
below. Braces stand for tables, so that one text serves Spark and any other SQL engine.
Every row of the driving table is used, and the dimension tables are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

POSTINGS = """
SELECT d.doc_id AS seq, d.source,
       concat('https://', d.source, '.example.com/job/', CAST(d.doc_id AS STRING)) AS url,
       p.p_name AS title, s.s_name AS company,
       CASE WHEN d.doc_id % 11 <> 0 THEN concat(n.n_name, d.place) END AS location,
       d.country, d.remote, d.seniority, d.stack_csv, d.visa_raw, v.phrase,
       v.truth AS visa_truth, d.salary_text, d.years,
       concat('Advert ', CAST(d.doc_id AS STRING), ' of ', s.s_name, ' on ', d.source) AS description_summary,
       d.text, e.embedding AS vector
FROM (SELECT doc_id, source, text,
             CASE doc_id % 6 WHEN 0 THEN 'IE' WHEN 1 THEN 'DE' WHEN 2 THEN 'NL' WHEN 3 THEN 'CA' WHEN 4 THEN 'US' END AS country,
             CASE doc_id % 6 WHEN 0 THEN ', Ireland' WHEN 1 THEN ', Germany' WHEN 2 THEN ', Netherlands'
                             WHEN 3 THEN ', Canada' WHEN 4 THEN ', United States' ELSE '' END AS place,
             CASE doc_id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' ELSE 'unknown' END AS remote,
             CASE doc_id % 7 WHEN 0 THEN 'junior' WHEN 1 THEN 'mid' WHEN 2 THEN 'senior' WHEN 3 THEN 'staff'
                             WHEN 4 THEN 'lead' ELSE 'unknown' END AS seniority,
             CASE doc_id % 8 WHEN 0 THEN 'Rust,Redis,Terraform' WHEN 1 THEN 'Python,GCP' WHEN 2 THEN 'React,TypeScript'
                             WHEN 3 THEN 'Go,Docker' WHEN 4 THEN 'Java,Kafka,PostgreSQL' WHEN 5 THEN 'Scala,Spark'
                             WHEN 6 THEN 'Rust,Kubernetes,Docker' ELSE '' END AS stack_csv,
             CASE doc_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS visa_raw,
             CASE WHEN doc_id % 5 = 0 THEN concat(CAST(40 + doc_id % 50 AS STRING), ',000 - ',
                  CAST(100 + doc_id % 80 AS STRING), ',000 EUR per year') ELSE '' END AS salary_text,
             doc_id % 9 AS years,
             doc_id % (SELECT count(*) FROM {part}) AS part_key,
             doc_id % (SELECT count(*) FROM {supplier}) AS supplier_key,
             doc_id % (SELECT count(*) FROM {embeddings}) AS vec_key
      FROM {documents}) d
JOIN {part} p ON p.p_partkey = d.part_key
JOIN {supplier} s ON s.s_suppkey = d.supplier_key
JOIN {nation} n ON n.n_nationkey = s.s_nationkey
JOIN {embeddings} e ON e.vec_id = d.vec_key
JOIN (VALUES (0, 'visa sponsorship available', 'yes'), (1, 'we can sponsor a visa', 'yes'), (2, 'we can sponsor', 'yes'),
             (3, 'relocation package', 'yes'), (4, 'EU Blue Card', 'yes'), (5, 'Critical Skills', 'yes'),
             (6, 'highly skilled migrant', 'yes'), (7, 'HSM route', 'yes'), (8, 'LMIA', 'yes'),
             (9, 'work permit provided', 'yes'), (10, 'must already have the right to work', 'no'),
             (11, 'valid work authorization', 'no'), (12, 'must be authorized to work', 'no'), (13, 'no sponsorship', 'no'),
             (14, 'unable to sponsor', 'no'), (15, 'without sponsorship', 'no'),
             (16, 'relocation package; no visa sponsorship', 'no'), (17, 'we do not provide visa sponsorship', 'no'),
             (18, '', 'unknown'), (19, 'free lunch', 'unknown')) AS v(k, phrase, truth) ON v.k = d.doc_id % 20
"""

# A captured page for every posting, with the whole document as its body. Labelled
# documents are posted a second time, on another board and with one more line. The columns
# behind ``html`` are what the page was made from.
POSTING_PAGES = """
SELECT q.item AS seq, q.board AS source, q.address AS url,
       concat('<!doctype html><html><head><title>', q.title, ' - ', q.company, '</title><script>var t="</p>";</script></head>',
              '<body><nav>Home &middot; Jobs</nav><main><h1>', q.title, '</h1><p>', q.company, '</p><p>',
              coalesce(q.location, 'Anywhere'), CASE WHEN q.remote = 'unknown' THEN '' ELSE concat(' (', q.remote, ')') END, '</p><ul>',
              CASE WHEN q.seniority = 'unknown' THEN concat('<li>', CAST(q.years AS STRING), '+ years of experience</li>')
                   ELSE concat('<li>', q.seniority, '-level role</li>') END,
              '<li>', q.phrase, '</li><li>Stack: ', q.stack_csv, '</li><li>', q.salary_text, '</li>', q.note, '</ul><section><p>',
              replace(replace(replace(q.text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
              '</p></section></main><footer>All rights reserved</footer></body></html>') AS html,
       q.title, q.company, q.seniority, q.visa_truth AS visa_sponsorship, q.remote
FROM (WITH base AS (""" + POSTINGS + """)
      SELECT base.*, 3 * base.seq AS item, base.source AS board, base.url AS address, '' AS note FROM base
      UNION ALL
      SELECT base.*, 3 * base.seq + 1 AS item, 'mirror' AS board, concat(base.url, '/repost') AS address, '<li>Reposted</li>' AS note
      FROM base JOIN {labels} l ON l.doc_id = base.seq) q
"""

# Three captured model answers per posting: prose, fences, wrong types, good records.
ANSWERS = """
SELECT q.seq, q.text, q.attempt,
       CASE WHEN q.kind = 0 THEN concat('The advert (', q.title, ') came back empty')
            WHEN q.kind = 7 THEN concat('{{"title":"', q.title, '","stack":[]}}')
            WHEN q.kind = 8 THEN concat('{{"title":"', q.title, '"}} {{"company":"', q.company, '"}}')
            WHEN q.kind = 10 THEN concat('```json', chr(10), q.head, ',"stack":["Go","Kafka"]}}', chr(10), '```')
            WHEN q.kind = 11 THEN concat('Here it is: ', q.head, ',"stack":[]}} Anything else?')
            WHEN q.kind = 13 THEN concat('{{"title":"', q.title, '","company":"', q.company, '"}}')
            ELSE concat(q.head, CASE q.kind
                 WHEN 1 THEN ',"seniority":"SENIOR"' WHEN 2 THEN ',"stack":null' WHEN 3 THEN ',"stack":["Go",1]'
                 WHEN 4 THEN concat(',"description_summary":"', q.escaped, '"')
                 WHEN 5 THEN ',"salary":{{"min":"90k"}}' WHEN 6 THEN ',"posted_at":"next week"'
                 WHEN 9 THEN ',"remote":null'
                 WHEN 12 THEN ',"salary":{{"min":"90000","max":true,"currency":"EUR","period":null}},"posted_at":1700000000'
                 WHEN 14 THEN ',"posted_at":"2024-05-01T10:00:00+02:00","rating":5,"salary":null'
                 ELSE ',"posted_at":1700000000000,"salary":{{"min":1.5,"max":2}}' END, '}}')
       END AS output
FROM (SELECT p.seq, p.text, a.attempt, p.title, p.company, (p.seq * 3 + a.attempt * 5) % 16 AS kind,
             replace(replace(replace(replace(replace(p.text, chr(92), concat(chr(92), chr(92))), '"', concat(chr(92), '"')),
                     chr(10), concat(chr(92), 'n')), chr(13), concat(chr(92), 'r')), chr(9), concat(chr(92), 't')) AS escaped,
             concat('{{"title":"', p.title, '","company":"', p.company, '","location":',
                    CASE WHEN p.location IS NULL THEN 'null' ELSE concat('"', p.location, '"') END, ',"visa_sponsorship":"', p.visa_raw,
                    '","visa_signals":["', p.phrase, '"]') AS head
      FROM (""" + POSTINGS + """) p {attempts}) q
"""

# Captured fetch attempts: some pages answer late, some not within two attempts.
FETCH_ATTEMPTS = """
SELECT p.url, a.attempt,
       CASE WHEN (p.page_id % 5 = 0 AND a.attempt <= 2) OR (p.page_id % 3 = 0 AND a.attempt = 1) THEN NULL ELSE p.html END AS html,
       CASE WHEN (p.page_id % 5 = 0 AND a.attempt <= 2) OR (p.page_id % 3 = 0 AND a.attempt = 1)
            THEN concat('HTTP 50', CAST(a.attempt AS STRING)) END AS error
FROM {pages} p {attempts}
"""

# Work items: every captured page, and one url per label that was never captured.
WORK_ITEMS = """
SELECT 3 * page_id AS seq, concat('board', CAST(page_id % 9 AS STRING)) AS source, url FROM {pages}
UNION ALL
SELECT 3 * doc_id + 2 AS seq, 'lost' AS source, concat('https://lost.example.com/', CAST(doc_id AS STRING)) AS url FROM {labels}
"""

# Every vector, and a copy that is moved along its first axis, by more or by less
# (Spark's dialect; the other engine's form stands with its queries).
MOVED_VECTORS = """
SELECT 2 * vec_id AS seq, CAST(embedding AS ARRAY<DOUBLE>) AS vector FROM {embeddings}
UNION ALL
SELECT 2 * vec_id + 1 AS seq, concat(array(CAST(embedding[0] AS DOUBLE) + (vec_id % 8) * CAST('0.05' AS DOUBLE)),
                                     slice(CAST(embedding AS ARRAY<DOUBLE>), 2, size(embedding) - 1)) AS vector
FROM {embeddings}
"""

# A call log: one call per conversation turn, four characters to a token.
CALLS = """
SELECT conv_id AS run_id, turn, CASE conv_id % 7 WHEN 0 THEN 'claude-haiku-4-5' WHEN 1 THEN 'claude-opus-4-8' WHEN 2 THEN 'gpt-5-mini'
            WHEN 3 THEN 'gpt-5' WHEN 4 THEN 'text-embedding-3-small' WHEN 5 THEN 'text-embedding-3-large' ELSE 'home-grown' END AS model,
       CASE WHEN role = 'assistant' THEN 0 ELSE CAST(ceil(length(text) / 4) AS BIGINT) END AS input_tokens,
       CASE WHEN role = 'assistant' THEN CAST(ceil(length(text) / 4) AS BIGINT) ELSE 0 END AS output_tokens
FROM {conversations}
"""

# A run log: an event is an entry of the run of its user.
RUN_LOG = """
SELECT user_id AS run_id, ts, event_id AS entry_id,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'done' ELSE 'running' END AS state,
       CASE WHEN event_type IN ('purchase', 'view') THEN value END AS result,
       CASE WHEN event_type = 'error' THEN props END AS error
FROM {events}
"""


def spread(df: DataFrame) -> DataFrame:
    """A table read in fewer pieces than there are cores, dealt out over all of them.

    For text tables, whose rows are costly to work on. A table of any size is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    sql = sql.replace("{attempts}", "LATERAL VIEW explode(array(1, 2, 3)) a AS attempt")
    used = {n: table(spark, sf_dir, n) for n in TABLES if "{" + n + "}" in sql}
    return spark.sql(sql, **used)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived postings with ``stack`` and ``visa_signals`` as arrays."""
    raw = derive(spark, sf_dir, POSTINGS)
    non_empty = lambda items: F.filter(items, lambda x: x != "")
    return raw.withColumns(
        {
            "stack": non_empty(F.split("stack_csv", ",")),
            "visa_signals": non_empty(F.array("phrase")),
        }
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of the embeddings table as a profile."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cv_id"), F.col("embedding").alias("cv_vector")
    )
