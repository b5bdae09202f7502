"""Mail tables synthesised from the driver's tables, as SQL that Spark and DuckDB read alike.

Queries run over these; their SQL twins begin with the same text, so both engines see the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LAYERS = """
SELECT CAST(conv_id AS BIGINT) AS email_id, CAST(turn AS INT) AS layer_seq, CAST(turn % 3 AS INT) AS layer_depth,
  concat(CASE (conv_id + turn) % 8 WHEN 0 THEN 'FW: ' WHEN 1 THEN 'Proofpoint ' WHEN 2 THEN 'please review ' WHEN 3 THEN 'Quarantine notice '
    WHEN 4 THEN 'suspicious mail ' WHEN 5 THEN '' WHEN 6 THEN 'Re: ' ELSE 'ESA ' END, trim(replace(substr(coalesce(text, ''), 1, 40), chr(10), ' '))) AS subject,
  concat(role, '@', CASE conv_id % 3 WHEN 0 THEN 'example.com' WHEN 1 THEN 'security.example.org' ELSE 'corp.example.net' END) AS from_addr,
  concat('Mon, 01 Jan 2024 00:00:', lpad(CAST(turn % 60 AS STRING), 2, '0'), ' +0000') AS date,
  CASE WHEN conv_id % 5 = 0 THEN '' ELSE concat('<', CAST(conv_id AS STRING), '.', CAST(CASE WHEN turn % 4 = 3 THEN turn - 1 ELSE turn END AS STRING), '@x>') END AS message_id,
  CASE (conv_id + turn) % 11 WHEN 3 THEN 'X-MC-Unique:1' WHEN 4 THEN concat('Received:by x', chr(10), 'X-IronPort-AV:E=1') WHEN 5 THEN 'X-Microsoft-Antispam:BCL:0' ELSE 'MIME-Version:1.0' END AS headers,
  concat(replace(coalesce(text, ''), chr(13), ''),
    CASE WHEN turn % 2 = 0 THEN concat(' see https://bit.ly/', CAST(conv_id AS STRING), ' or www.example.org/a). and HTTP://u@bit.ly:80/x;') ELSE '' END,
    CASE (conv_id + turn) % 7 WHEN 1 THEN concat(chr(10), '-----Original Message-----', chr(10), 'From: a@example.com', chr(10), 'Sent: today', chr(10), 'To: b@example.org', chr(10), 'Subject: hi')
      WHEN 2 THEN concat(chr(10), 'please review this suspicious email', chr(10), 'Begin forwarded message:', chr(10), 'Date: now')
      WHEN 3 THEN concat(chr(10), 'Received: from a by b', chr(10), 'MIME-Version: 1.0', chr(10), 'our team flagged it as suspicious') ELSE '' END) AS plain_text
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
"""

ATTACHMENTS = """
SELECT CAST(doc_id % 50 AS BIGINT) AS email_id, CAST(doc_id % 3 AS INT) AS layer_seq, CAST(doc_id % 3 AS INT) AS layer_depth, CAST(doc_id AS BIGINT) AS idx,
  concat('doc_', CAST(doc_id AS STRING), CASE doc_id % 6 WHEN 0 THEN '.eml' WHEN 1 THEN '.exe' WHEN 2 THEN '.pdf' WHEN 3 THEN '.xlsx' WHEN 4 THEN '.txt' ELSE '.EML' END) AS filename,
  CASE doc_id % 6 WHEN 0 THEN 'application/octet-stream' WHEN 5 THEN 'message/rfc822' WHEN 2 THEN 'application/pdf' ELSE 'application/x' END AS content_type,
  coalesce(text, '') AS content
FROM documents WHERE doc_id IS NOT NULL
"""

URLS = """
SELECT CAST(page_id % 50 AS BIGINT) AS email_id, CAST(page_id % 3 AS INT) AS layer_seq, CAST(page_id % 3 AS INT) AS layer_depth, CAST(page_id AS BIGINT) AS pos,
  CASE page_id % 3 WHEN 0 THEN 'body_text' WHEN 1 THEN 'image_ocr' ELSE 'attachment_text' END AS source,
  CASE WHEN page_id % 17 = 0 THEN 'http://u@bit.ly:80/x' WHEN page_id % 13 = 0 THEN concat(coalesce(url, ''), ').')
    WHEN page_id % 11 = 0 THEN concat('https://x.example/?url=', replace(replace(replace(coalesce(url, ''), '%', '%25'), '&', '%26'), '#', '%23'))
    WHEN page_id % 19 = 0 THEN concat('https://defense.example/v1/url?u=http%253A%252F%252Fexample.org%252Fa%252Bb&k=', CAST(page_id AS STRING))
    WHEN page_id % 7 = 0 THEN concat('www.example.org/', CAST(page_id % 9 AS STRING), '.PNG?x=1')
    WHEN page_id % 5 = 0 THEN concat('HTTPS://', CASE page_id % 4 WHEN 0 THEN 'bit.ly' WHEN 1 THEN 'a.t.co' WHEN 2 THEN 'cutt.ly' ELSE 'example.org' END, '/', CAST(page_id % 20 AS STRING), '?#')
    ELSE coalesce(url, '') END AS original_url
FROM pages WHERE page_id IS NOT NULL
"""

IMAGES = """
SELECT CAST(doc_id % 40 AS BIGINT) AS email_id, CAST(doc_id % 3 AS INT) AS layer_seq, CAST(doc_id % 3 AS INT) AS layer_depth, CAST(doc_id AS BIGINT) AS idx,
  concat('img_', CAST(doc_id % 7 AS STRING), '.png') AS filename, CAST(doc_id % 4 AS BIGINT) AS size, doc_id % 2 = 1 AS embedded,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat(coalesce(text, ''), ' https://bit.ly/', CAST(doc_id AS STRING), '.') END AS ocr_text
FROM documents WHERE doc_id IS NOT NULL
"""

REQUESTS = """
SELECT CAST(event_id AS BIGINT) AS item_idx, CAST(user_id AS BIGINT) AS user_id,
  CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 9 = 0 THEN 'abc' ELSE 'aGVsbG8=' END END AS email_data,
  CASE WHEN event_id % 4 IN (0, 1) THEN 'd29ybGQ=' END AS data,
  CASE WHEN event_id % 4 IN (0, 2) THEN 'bWFpbA==' END AS email_content,
  CASE WHEN event_id % 5 > 0 THEN concat('m', CAST(event_id AS STRING), '.eml') END AS filename,
  event_type, props
FROM events WHERE event_id IS NOT NULL
"""

TABLES = {"mail_layers": LAYERS, "mail_attachments": ATTACHMENTS, "mail_urls": URLS, "mail_images": IMAGES, "requests": REQUESTS}
SOURCES = {"mail_layers": "conversations", "mail_attachments": "documents", "mail_urls": "pages", "mail_images": "documents", "requests": "events"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = SOURCES[name]
    read = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(TABLES[name].replace(f"FROM {source} ", "FROM {source} "), source=read)


def cte(*names: str) -> str:
    """WITH ... for a DuckDB query over these tables."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n]})" for n in names) + "\n"
