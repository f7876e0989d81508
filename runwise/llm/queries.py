"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runwise.llm import (bpe_fst, fim_frames, html_diff, langid_nb, ngram_join, pii, quality_ledger, suffix_dedup, template_decontam,
                         toxicity_crf, warc_archive, whitening, window_lm)
from runwise.llm.common import release, shared_folder, table


def op1_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_crf.report(table(spark, sf_dir, "documents", "doc_id", "text"),
                               table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    folder = warc_archive.write_archive(pages, shared_folder(spark, "warc"))
    release(spark)
    rebuilt = warc_archive.read_archive(spark, folder).drop("payload")
    digests = [F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256")]
    return rebuilt.select(*[c for c in rebuilt.columns if c != "record"], *digests)


def op3_html_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents", "doc_id", "text")).drop("tag")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_fst.report(table(spark, sf_dir, "documents", "doc_id", "text"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_window_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_lm.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_nb.report(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op9_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontam.leaks(table(spark, sf_dir, "documents", "doc_id", "text"),
                                   table(spark, sf_dir, "benchmark", "item_id", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_fim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_frames.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity_crf, op2_warc_archive, op3_html_diff, op4_suffix_dedup, op5_ngram_join, op6_byte_bpe, op7_window_lm,
    op8_language_id, op9_template_decontam, op10_quality_rules, op11_pii, op12_fim_frames, op13_whitening)}

def _template_sql() -> str:
    """Op9 in DuckDB by its definition: canonical tokens, windows, all alignments that share enough tokens, slot check."""
    def steps(expr: str, which) -> str:
        for pattern, to in which:
            expr = f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"
        return expr
    T = template_decontam
    raw = "trim(" + steps("lower(" + steps("text", [T.NAMES]) + ")", T.STEPS) + ")"
    form = "CASE WHEN substr(x, 1, 1) IN ('#', '@', '~') THEN substr(x, 1, 1) ELSE x END"
    W = T.WINDOW

    def key(f: str, r: str) -> str:
        cut = f"{f}[p0 + 1:p0 + {W}]"
        return (f"CASE WHEN 2 * len(list_filter({cut}, lambda x: x NOT IN ('#', '@', '~'))) >= {W} THEN 'form ' || array_to_string({cut}, ' ') "
                f"ELSE 'raw ' || array_to_string({r}[p0 + 1:p0 + {W}], ' ') END")

    enough = lambda c: f"(CASE WHEN n < {T.LEAST_TOKENS} THEN {c} = n ELSE 100 * {c} >= {T.FOUND} * n END)"
    return f"""
        WITH d0 AS (SELECT DISTINCT doc_id, text, list_filter(string_split({raw}, ' '), lambda x: x <> '') AS raw
                    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        d AS (SELECT row_number() OVER () AS r, doc_id, raw, list_transform(raw, lambda x: {form}) AS form FROM d0),
        i0 AS (SELECT DISTINCT item_id, text, list_filter(string_split({raw}, ' '), lambda x: x <> '') AS item_raw
               FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        i1 AS (SELECT row_number() OVER () AS i, item_id, item_raw, list_transform(item_raw, lambda x: {form}) AS item_form, len(item_raw) AS n FROM i0
               WHERE len(item_raw) > 0),
        i2 AS (SELECT *, CASE WHEN n < {T.LEAST_TOKENS} THEN 0 ELSE (100 - {T.FOUND}) * n // 100 END AS m,
                      len(list_filter(item_form[2:], lambda x: x NOT IN ('#', '@', '~'))) AS literals FROM i1),
        it AS (SELECT *, literals <= m AS sparse FROM i2),
        dt AS (SELECT r, generate_subscripts(raw, 1) - 1 AS p, unnest(raw) AS raw, unnest(form) AS form FROM d),
        tt AS (SELECT i, n, m, literals, sparse, generate_subscripts(item_raw, 1) - 1 AS k, unnest(item_raw) AS raw, unnest(item_form) AS form FROM it),
        hits AS (
            SELECT dw.r, iw.i, dw.p0 - iw.p0 AS shift, false AS by_seeds
            FROM (SELECT r, p0, {key('form', 'raw')} AS w FROM (SELECT r, raw, form, unnest(range(0, len(form) - {W} + 1)) AS p0 FROM d)) dw
            JOIN (SELECT i, p0, {key('item_form', 'item_raw')} AS w FROM (SELECT i, item_raw, item_form, unnest(range(0, n - {W} + 1)) AS p0 FROM it)) iw
                 USING (w)
            UNION ALL
            SELECT r, i, p - k AS shift, true FROM dt JOIN tt ON dt.raw = tt.raw AND tt.form = tt.raw AND tt.k > 0 AND NOT tt.sparse
            GROUP BY r, i, shift, literals, m HAVING count(*) >= literals - m
            UNION ALL
            SELECT r, i, p - k, true FROM dt JOIN tt ON dt.raw = tt.raw WHERE (tt.k > 0 OR tt.n = 1) AND tt.sparse
            UNION ALL
            SELECT r, i, p - k, true FROM dt JOIN tt ON dt.raw = '@' || tt.raw WHERE tt.n = 1 AND tt.sparse
            UNION ALL
            SELECT r, i, p0, false FROM (SELECT r, form, i, item_form, n, unnest(range(0, len(form) - n + 1)) AS p0 FROM d, it WHERE sparse AND n >= {T.LEAST_TOKENS})
            WHERE form[p0 + 1:p0 + n] = item_form),
        hit AS (SELECT r, i, shift, bool_and(by_seeds) AS by_seeds FROM hits GROUP BY ALL),
        same AS (SELECT h.r, h.i, h.shift, h.by_seeds, tt.n, tt.sparse, tt.k, tt.form IN ('#', '@', '~') AS slot, tt.raw AS a, dt.raw AS b,
                        tt.raw = dt.raw OR tt.k = 0 AND dt.raw = '@' || tt.raw AS equal
                 FROM hit h JOIN tt ON tt.i = h.i JOIN dt ON dt.r = h.r AND dt.p = tt.k + h.shift
                 WHERE tt.form = dt.form OR tt.k = 0 AND dt.raw = '@' || tt.raw),
        judged AS (SELECT r, i, shift, by_seeds, n, sparse, count(*) AS n_same, count(*) FILTER (equal) AS n_equal,
                          count(DISTINCT (a, b)) FILTER (slot) = count(DISTINCT a) FILTER (slot)
                            AND count(DISTINCT (a, b)) FILTER (slot) = count(DISTINCT b) FILTER (slot) AS consistent,
                          coalesce(bool_or(a <> b) FILTER (slot), false) AS differs
                   FROM same GROUP BY ALL),
        counted AS (SELECT * FROM judged WHERE NOT by_seeds OR {enough("CASE WHEN sparse THEN n_equal ELSE n_same END")}),
        item AS (SELECT s.r, s.i, s.n, count(DISTINCT s.k) FILTER (c.consistent OR s.equal) AS n_found, bool_or(c.consistent AND c.differs) AS changed
                 FROM same s JOIN counted c ON c.r = s.r AND c.i = s.i AND c.shift = s.shift GROUP BY ALL),
        good AS (SELECT d.doc_id, it.item_id, {{'f': n_found::BIGINT, 'n': item.n::BIGINT,
                        'k': CASE WHEN changed THEN 'reparameterised' WHEN n_found = item.n THEN 'whole' ELSE 'partial' END}} AS s
                 FROM item JOIN d ON d.r = item.r JOIN it ON it.i = item.i WHERE {enough('n_found').replace('n <', 'item.n <').replace('= n ', '= item.n ').replace('* n ', '* item.n ')})
        SELECT doc_id, item_id, max(s).n AS n_tokens, max(s).f AS n_found, max(s).k AS kind FROM good GROUP BY doc_id, item_id"""


def _pii_sql() -> str:
    """Op11 in DuckDB: the contract's own patterns, positions by running sums over exploded matches."""
    kinds = list(pii.KINDS)
    patterns = {**pii.PLAIN, **pii.ADDED}
    found = " UNION ALL ".join(
        f"SELECT r, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{patterns[kind]}') AS ms, string_split_regex(t, '{patterns[kind]}') AS ps "
        f"FROM d WHERE regexp_matches(t, '{patterns[kind]}')" for k, kind in enumerate(kinds))
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, strlen({digits}) + 1), lambda i: CASE WHEN (strlen({digits}) - i) % 2 = 0
               THEN substr({digits}, i, 1)::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr({digits}, i, 1)::INT + 1] END)) % 10 = 0"""
    apart = f"NOT regexp_matches(before, '{pii.GOES_ON_BEFORE}') AND NOT regexp_matches(after, '{pii.GOES_ON_AFTER}')"

    def confirmed(text: str) -> str:
        number = f"replace({text}, ' ', '')"
        turned = f"(substr({number}, 5) || substr({number}, 1, 4))"
        codes = (f"list_transform(range(1, strlen({number}) + 1), lambda i: CASE WHEN ascii(substr({turned}, i, 1)) < 58 "
                 f"THEN ascii(substr({turned}, i, 1)) - 48 ELSE ascii(substr({turned}, i, 1)) - 55 END)")
        rest = f"list_reduce(list_prepend(0, {codes}), lambda a, x: (a * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97)"
        return f"(strlen({number}) BETWEEN 15 AND 34 AND {rest} = 1)"

    shorter = r"regexp_replace(m, '\x20[A-Z0-9]+$', '')"
    starts = "NOT regexp_matches(before, '[A-Za-z0-9]$')"
    accepted = {
        "email": "m", "ip": f"CASE WHEN regexp_matches(m, '{pii.OCTET}') THEN m END",
        "card": f"CASE WHEN strlen({digits}) BETWEEN 13 AND 19 AND {luhn} THEN m END",
        "phone": f"CASE WHEN strlen({digits}) BETWEEN 9 AND 15 THEN m END",
        "iban": f"CASE WHEN {starts} AND NOT regexp_matches(after, '^[A-Za-z0-9]') AND {confirmed('m')} THEN m "
                f"WHEN {starts} AND {confirmed(shorter)} THEN {shorter} END",
        "ssn": f"CASE WHEN {apart} AND regexp_matches(m, '{pii.SSN}') THEN m END", "local": f"CASE WHEN {apart} THEN m END",
        "birth": f"CASE WHEN {apart} AND regexp_matches(m, '{pii.DATE}') THEN m END"}
    helps = " ".join(f"WHEN '{k}' THEN {pii.WEIGHT[k]} + CASE WHEN regexp_matches(near, '{pii.HELPS[k]}') THEN {pii.CONTEXT_BONUS} ELSE 0 END"
                     for k in kinds)
    text = " ".join(f"WHEN '{k}' THEN {accepted[k]}" for k in kinds)
    base = ", ".join(f"'{k}'" for k in pii.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)
    zeros = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in pii.BASE)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        f AS ({found}),
        e AS (SELECT r, k, kind, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS piece, unnest(ps[2:len(ms) + 1]) AS next,
                     unnest(range(len(ms))) AS i FROM f),
        s AS (SELECT *, right(piece, {pii.REACH}) AS before, left(next, {pii.REACH}) AS after,
                     sum(length(piece) + length(m)) OVER (PARTITION BY r, k ORDER BY i) - length(m) AS start FROM e),
        a AS (SELECT *, CASE kind {text} END AS ok, before || ' ' || after AS near FROM s),
        w AS (SELECT *, round(greatest(0, least(1, CASE kind {helps} END
                     - CASE WHEN regexp_matches(right(before, {pii.NEAREST}), '{pii.HURTS}') THEN {pii.CONTEXT_MALUS} ELSE 0 END)), 2) AS score FROM a),
        g AS (SELECT r, k, kind, start, kind || ':' || start::BIGINT || ':' || (start + length(ok))::BIGINT AS span FROM w
              WHERE ok IS NOT NULL AND (kind IN ({base}) OR score >= {pii.LEAST_SCORE})),
        c AS (SELECT r, {counts}, string_agg(span, ',' ORDER BY k, start) FILTER (kind IN ({base})) AS base,
                     string_agg(span, ',' ORDER BY k, start) AS spans, count(*) FILTER (kind NOT IN ({base})) AS n_added FROM g GROUP BY r)
        SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0)::BIGINT AS n_added
        FROM d LEFT JOIN c USING (r)"""


_FIM_SQL = r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
        u AS (SELECT doc_id, t, regexp_extract_all(t, '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS us,
                     ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
        f AS (SELECT *, len(us)::BIGINT AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                          WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, coalesce(array_to_string(us[1:a], ''), '') AS pre, coalesce(array_to_string(us[a + 1:b], ''), '') AS mid,
                     coalesce(array_to_string(us[b + 1:n], ''), '') AS suf FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p"""


ORACLES = {
    "op11_pii": _pii_sql(),
    "op12_fim_frames": _FIM_SQL,
    "op9_template_decontam": _template_sql(),
    "op2_warc_archive": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
        s AS (SELECT page_id, url, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hexed,
                     min(page_id) OVER (PARTITION BY body) AS first_id FROM p),
        r AS (SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(hexed, (k // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (k % 8))::INTEGER) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to, url
        FROM s),
        l AS (SELECT *, chr(13) || chr(10) AS nl, payload_bytes || '' AS n, record_type = 'revisit' AS again FROM r JOIN p USING (page_id, url)),
        h AS (SELECT *, 'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || n || nl || nl AS http FROM l),
        w AS (SELECT *, 'WARC/1.1' || nl || 'WARC-Type: ' || record_type || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl
                  || coalesce('WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || nl, '')
                  || 'WARC-Date: 1970-01-01T00:00:00Z' || nl || 'WARC-Payload-Digest: sha1:' || payload_digest || nl
                  || CASE WHEN again THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || nl
                          || 'WARC-Refers-To: <urn:page:' || refers_to || '>' || nl ELSE '' END
                  || 'Content-Type: application/http; msgtype=response' || nl
                  || 'Content-Length: ' || (strlen(http) + CASE WHEN again THEN 0 ELSE payload_bytes END) || nl || nl || http
                  || CASE WHEN again THEN '' ELSE body END || nl || nl AS record FROM h)
        SELECT page_id, payload_bytes, payload_digest, record_type, refers_to, url, strlen(record)::BIGINT AS record_bytes,
               sha256(record) AS record_sha256 FROM w""",
    "op10_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
                FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
        cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
        m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, (length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')))::BIGINT AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                     (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
                     len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up,
                     length(regexp_replace(t, '[^a-z]', '', 'g')) AS low, length(regexp_replace(t, '[^!]', '', 'g')) AS marks
              FROM w LEFT JOIN cov USING (doc_id)),
        f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                     + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
                     + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
                     + CASE WHEN 2 * up > up + low THEN 64 ELSE 0 END + CASE WHEN 100 * marks > 20 * n_words THEN 128 ELSE 0 END
                     + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 256 ELSE 0 END)::BIGINT AS failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed & 255 = 0 AS kept, failed,
               CASE failed & 255 WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines'
                    WHEN 16 THEN 'short_words' WHEN 32 THEN 'long_words' WHEN 64 THEN 'capitals' WHEN 128 THEN 'exclamations' END AS sole_rule,
               CASE WHEN (failed & 255) IN (1, 2, 4, 8, 16, 32, 64, 128) THEN count(*) OVER (PARTITION BY failed & 255) END AS saved_without
        FROM f""",
}
