"""The same queries in SQL, written apart from the operators."""

from __future__ import annotations

# Fixed values, stated here once more so that a slip in the operators shows.
TRADITIONAL = "這個說過會時問學來對開關們還給經麼點邊裡後聽覺應該與實際變數據題頁圖樣條習課講請讓長樂東車馬門見貝"
SIMPLIFIED = "这个说过会时问学来对开关们还给经么点边里后听觉应该与实际变数据题页图样条习课讲请让长乐东车马门见贝"
MARKS = '，。！？、；：“”‘’（）《》【】…—,.!?;:"\'()[]-~·'
NOISE = [r"关注", r"点赞", r"投币", r"一键三连", r"扫码", r"加群", r"优惠", r"http", r"www\.", r"@[A-Za-z0-9_]+", r"^[A-Za-z0-9]{1,3}$"]
MISREAD = {"囗": "口", "曰": "日", "巳": "已", "末": "未"}
FAILURES = [(27, "no audio|audio stream"), (21, "403|forbidden|login|cookie"), (22, "timeout|timed out|ssl|connection|412|429|too many requests|rate limit"), (23, "quality|resolution"), (24, "transcri|whisper|cuda"), (26, "browser|cdp|playwright"), (20, "404|not found|deleted|no stream|不存在")]
FORBIDDEN_SUFFIXES = ["mp4", "mkv", "flac", "wav", "mp3", "m4a", "cookies", "pem", "key"]
FORBIDDEN_NAMES = [".env", "cookies.txt", "cookie.txt"]
FORBIDDEN = {
    "machine_path": r"[A-Za-z]:\\Users\\|/home/[a-z]|/Users/[A-Za-z]",
    "loopback_address": r"127\.0\.0\.1:\d{2,5}",
    "credential": r"SESSDATA=|sessionid=|sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9_]{20,}|BEGIN [A-Z ]*PRIVATE KEY",
}
STEP_LABELS = {"asr_engine": "Recogniser", "asr_coverage": "Coverage", "asr_chunking": "Chunks", "asr_confidence": "Confidence", "asr_hallucination_gate": "Hallucination gate", "simplify": "Simplified characters", "local_video": "Local file"}
REDACTIONS = [
    (r"(?i)(SESSDATA|bili_jct|sessionid|ttwid|cookie)\s*[=:]\s*[^\s;,]+", "[cookie]"),
    (r"(?i)(access_token|api_key|apikey|secret|authorization)\s*[=:]\s*[^\s;,]+", "[token]"),
    (r"https?://[^\s]*[?&](sign|signature|token|expires|auth_key)=[^\s]*", "[signed-url]"),
    (r"[A-Za-z]:\\Users\\[^\\\s]+", "[home]"),
    (r"/(home|Users)/[A-Za-z0-9_.-]+", "[home]"),
    (r"/tmp/[A-Za-z0-9_./-]+", "[tmp]"),
]

SEG = """seg AS (SELECT segment_id, any_value(result_id) AS result_id, any_value(media_id) AS media_id, any_value(seg_no) AS seg_no,
  CAST(round(any_value(from_s) * 1000) AS BIGINT) AS start_ms, CAST(round(any_value(to_s) * 1000) AS BIGINT) AS end_ms,
  any_value(content) AS text, any_value(avg_logprob) AS avg_logprob, any_value(no_speech_prob) AS no_speech_prob,
  any_value(compression_ratio) AS compression_ratio FROM segments GROUP BY segment_id)"""
CARD = """card AS (SELECT card_id, any_value(media_id) AS media_id, CAST(round(any_value(shown_s) * 1000) AS BIGINT) AS start_ms,
  CAST(round(any_value(gone_s) * 1000) AS BIGINT) AS end_ms, any_value(text) AS text, any_value(ocr_confidence) AS ocr_confidence
  FROM cards GROUP BY card_id)"""
CHUNK = """chunk AS (SELECT chunk_id, any_value(result_id) AS result_id, any_value(chunk_no) AS chunk_no,
  CAST(round(any_value(from_s) * 1000) AS BIGINT) AS start_ms, CAST(round(any_value(to_s) * 1000) AS BIGINT) AS end_ms,
  any_value(text) AS text FROM chunks GROUP BY chunk_id)"""
HIST = """h AS (SELECT media_id AS "case", model_size AS norm, created_at, result_id, elapsed FROM results)"""


#: Types of the columns that sums and counts would widen.
_TYPES = {
    "short_fragment_merge": {"piece_no": "BIGINT"}, "card_runs": {"run_no": "BIGINT"}, "retry_windows": {"rank": "INTEGER"}, "interval_coverage": {"covered_ms": "BIGINT"},
    "coverage_repair": {"before_ms": "BIGINT", "after_ms": "BIGINT"}, "cards_over_segments": {"overlap_ms": "BIGINT"}, "completeness_report": {"n_changes": "BIGINT", "covered_ms": "BIGINT"},
    "topic_chunks": {"n_chars": "BIGINT"}, "lexicon_terms": {"rank": "INTEGER"}, "edit_distances": {"distance": "INTEGER"}, "repeated_ngrams": {"repeats": "INTEGER"}, "card_alignment_sums": {"ref_chars": "BIGINT", "hyp_chars": "BIGINT", "accounted": "BIGINT"},
    "char_overlap": {"n_shared": "INTEGER", "n_chars": "INTEGER"}, "refine_candidates": {"rank": "INTEGER"}, "run_summary": {"n_chars": "BIGINT", "n_steps": "INTEGER"}, "worksheet_flags": {"rank": "INTEGER"},
}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _nested(expr: str, steps: list[tuple[str, str]], flags: str = ", 'g'") -> str:
    for pattern, put in steps:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(put)}{flags})"
    return expr


def _union(name: str, key: str, source: str) -> str:
    """CTE of covered milliseconds per key of intervals in `source`."""
    return f"""{name} AS (SELECT {key}, sum(greatest(0, end_ms - greatest(start_ms, coalesce(until, start_ms)))) AS covered_ms FROM (
      SELECT {key}, start_ms, end_ms, max(end_ms) OVER (PARTITION BY {key} ORDER BY start_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until
      FROM {source} WHERE {key} IS NOT NULL AND start_ms IS NOT NULL AND end_ms >= start_ms) GROUP BY {key})"""


GAPS = """gaps AS (SELECT result_id, until AS gap_start_ms, start_ms AS gap_end_ms, start_ms - until AS gap_ms FROM (
  SELECT result_id, start_ms, max(end_ms) OVER (PARTITION BY result_id ORDER BY start_ms, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until
  FROM seg WHERE result_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms >= start_ms) WHERE start_ms - until >= 2000)"""
CHANGES = """chg AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR text IS DISTINCT FROM lag(text) OVER w THEN 1 ELSE 0 END AS is_change
  FROM card WHERE media_id IS NOT NULL AND start_ms IS NOT NULL WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, card_id))"""
NEAR = """near AS (SELECT card_id, media_id, segment_id, delta_ms FROM (SELECT c.card_id, c.media_id, s.id AS segment_id, abs(c.start_ms - s.t) AS delta_ms,
  row_number() OVER (PARTITION BY c.card_id ORDER BY abs(c.start_ms - s.t), s.t, s.id) AS r FROM card c
  JOIN (SELECT media_id, start_ms AS t, min(segment_id) AS id FROM seg WHERE start_ms IS NOT NULL GROUP BY ALL) s
  ON c.media_id = s.media_id AND s.t BETWEEN c.start_ms - 5000 AND c.start_ms + 5000) WHERE r = 1)"""


def _norm(expr: str) -> str:
    """The form texts are compared in, as SQL."""
    half = "".join(map(chr, range(0x21, 0x7F)))
    full = "".join(chr(ord(c) + 0xFEE0) for c in half)
    out = f"translate({expr}, {q(full + '　')}, {q(half + ' ')})"
    out = f"regexp_replace(translate({out}, {q(MARKS)}, ''), '\\s+', '', 'g')"
    return f"lower(translate({out}, {q(TRADITIONAL)}, {q(SIMPLIFIED)}))"


FUSED = f"""a AS (SELECT media_id, card_id AS p, start_ms, end_ms, coalesce(text, '') AS text FROM card WHERE media_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms >= start_ms),
  b AS (SELECT media_id, segment_id AS q, start_ms, end_ms, coalesce(text, '') AS text FROM seg WHERE media_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms >= start_ms),
  own AS (SELECT b.media_id, q, arg_max(p, row(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms), -a.start_ms, p)) AS p
    FROM a JOIN b ON a.media_id = b.media_id AND a.start_ms <= b.end_ms AND b.start_ms <= a.end_ms GROUP BY 1, 2),
  pr AS (SELECT own.q, a.text AS x, b.text AS y FROM own JOIN a ON a.p = own.p JOIN b ON b.q = own.q),
  cx AS (SELECT q, c, count(*) AS n FROM (SELECT q, unnest(string_split(x, '')) AS c FROM pr) GROUP BY 1, 2),
  cy AS (SELECT q, c, count(*) AS n FROM (SELECT q, unnest(string_split(y, '')) AS c FROM pr) GROUP BY 1, 2),
  sh AS (SELECT cx.q, sum(least(cx.n, cy.n)) AS shared FROM cx JOIN cy ON cx.q = cy.q AND cx.c = cy.c WHERE cx.c <> '' GROUP BY 1),
  w AS (SELECT b.*, own.p, own.p IS NOT NULL AND coalesce(sh.shared, 0) < 2 AND length(b.text) >= 2 AS lost FROM b LEFT JOIN own ON own.q = b.q LEFT JOIN sh ON sh.q = b.q),
  u AS (SELECT media_id, p, string_agg(text, '' ORDER BY start_ms, q) AS t, count(*) AS n FROM w WHERE p IS NOT NULL AND NOT lost GROUP BY 1, 2),
  k AS (SELECT a.*, u.t, u.n, u.t IS NULL OR {_norm("u.t")} = {_norm("a.text")} OR {_norm("u.t")} = '' OR contains({_norm("a.text")}, {_norm("u.t")}) AS same FROM a LEFT JOIN u ON u.p = a.p),
  fused AS (SELECT media_id, start_ms, end_ms, text, CASE WHEN same THEN 'subtitle' ELSE 'mixed' END AS provenance, CASE WHEN NOT same OR t <> text THEN t END AS alternative, NOT same AS needs_review,
      CAST(NULL AS VARCHAR) AS recovered_by, p AS piece_id, coalesce(n, 0) AS n_secondary FROM k
    UNION ALL SELECT media_id, start_ms, end_ms, text, 'asr', NULL, true, CASE WHEN p IS NOT NULL THEN 'coverage_audit' END, q, 1 FROM w WHERE p IS NULL OR lost)"""
_MARK_END = r"[，。！？、；：,.!?;:…”\"）)」]$"
_GOES = "^(?:但是|所以|因为|然后|而且|不过|如果)"
_IDENTITY = ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '~')" for c in ("engine", "model_size", "device", "compute_type", "chunked", "diarized", "punct_mode"))


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["segments_canonical"] = f"""WITH {SEG} SELECT segment_id, start_ms, end_ms, text, CASE WHEN start_ms IS NULL OR end_ms IS NULL THEN 'missing_time'
      WHEN end_ms < start_ms THEN 'reversed' WHEN text IS NULL THEN 'missing_text' ELSE 'ok' END AS status FROM seg"""
    sql["media_sources"] = """SELECT media_id, CASE WHEN media_id LIKE 'bl-%' THEN 'bilibili' WHEN media_id LIKE 'dy-%' THEN 'douyin' WHEN media_id LIKE 'lf-%' THEN 'local' END AS source_platform FROM media"""
    sql["source_links"] = r"""SELECT doc_id, canonical_id FROM (SELECT doc_id, coalesce(nullif(regexp_extract(text, '\b(BV[0-9A-Za-z]{10})\b', 1), ''),
      CASE WHEN regexp_extract(text, '(?i)\bav(\d{1,15})\b', 1) <> '' THEN 'av' || regexp_extract(text, '(?i)\bav(\d{1,15})\b', 1) END,
      CASE WHEN regexp_extract(text, 'douyin\.com/(?:video|note)/(\d{15,20})', 1) <> '' THEN 'dy' || regexp_extract(text, 'douyin\.com/(?:video|note)/(\d{15,20})', 1) END,
      CASE WHEN regexp_extract(text, '(?:b23\.tv|v\.douyin\.com)/([0-9A-Za-z_-]+)', 1) <> '' THEN 'short:' || regexp_extract(text, '(?:b23\.tv|v\.douyin\.com)/([0-9A-Za-z_-]+)', 1) END) AS canonical_id
      FROM documents) WHERE canonical_id IS NOT NULL"""
    sql["settings_identities"] = f"SELECT result_id, sha256(concat_ws('|', {_IDENTITY})) AS identity FROM results"
    sql["diagnostic_steps"] = "SELECT step, count(*) AS n_runs FROM (SELECT unnest(diagnostics) AS step FROM results) GROUP BY step"
    sql["timeline_check"] = f"""WITH {SEG} SELECT result_id, count(*) AS n_segments, count(*) FILTER (WHERE start_ms < b) AS n_regressions, count(*) FILTER (WHERE start_ms < u) AS n_overlaps
      FROM (SELECT result_id, start_ms, lag(start_ms) OVER w AS b, max(end_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM seg WHERE result_id IS NOT NULL
      WINDOW w AS (PARTITION BY result_id ORDER BY seg_no, segment_id)) GROUP BY result_id"""
    sql["filler_report"] = rf"""WITH {SEG}, f AS (SELECT lower(regexp_replace(word, '\s', '', 'g')) AS bare, min(word) AS word FROM fillers GROUP BY 1)
      SELECT segment_id, word FROM seg JOIN f ON lower(regexp_replace(text, '[\s，。、！？,.!?…~～]', '', 'g')) = f.bare"""
    sql["ocr_report"] = f"""WITH {CARD} SELECT media_id, count(*) AS n_cards, count(*) FILTER (WHERE ocr_confidence < 0.5) AS n_low_confidence,
      count(*) FILTER (WHERE regexp_matches(text, {q("|".join(f"(?:{p})" for p in NOISE))})) AS n_noise, count(*) FILTER (WHERE end_ms - start_ms < 500) AS n_short
      FROM card WHERE media_id IS NOT NULL GROUP BY media_id"""
    sql["corrected_cards"] = f"""WITH {CARD} SELECT card_id, text, corrected FROM (SELECT card_id, text, translate(translate(text, {q(TRADITIONAL)}, {q(SIMPLIFIED)}),
      {q("".join(MISREAD))}, {q("".join(MISREAD.values()))}) AS corrected FROM card) WHERE corrected <> text"""
    sql["quality_marks"] = f"""WITH {SEG} SELECT result_id, count(*) FILTER (WHERE avg_logprob < -1.0) AS n_low_confidence, count(*) FILTER (WHERE compression_ratio > 2.4) AS n_suspected,
      sum(CAST(round(avg_logprob * 1000000) AS BIGINT) * length(text)) / nullif(sum(CASE WHEN avg_logprob IS NOT NULL THEN length(text) END), 0) AS weighted_confidence
      FROM seg WHERE result_id IS NOT NULL GROUP BY result_id"""
    cases = " ".join(f"WHEN regexp_matches(lower(text), {q(p)}) THEN {c}" for c, p in FAILURES)
    sql["failure_codes"] = f"SELECT CASE WHEN text IS NULL THEN 0 {cases} ELSE 1 END AS status_code, count(*) AS n_docs FROM documents GROUP BY 1"
    sql["redactions"] = f"SELECT doc_id, redacted FROM (SELECT doc_id, text, {_nested('text', REDACTIONS)} AS redacted FROM documents) WHERE redacted <> text"
    sql["adjacent_duplicates"] = f"""WITH {SEG} SELECT segment_id FROM (SELECT segment_id, text, lag(text) OVER w AS b, row_number() OVER w AS r FROM seg WHERE result_id IS NOT NULL
      WINDOW w AS (PARTITION BY result_id ORDER BY seg_no, segment_id)) WHERE r > 1 AND text IS NOT DISTINCT FROM b"""
    sql["short_fragment_merge"] = f"""WITH {SEG} SELECT result_id, piece_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_parts, string_agg(coalesce(text, ''), '' ORDER BY seg_no, segment_id) AS text
      FROM (SELECT *, greatest(sum(CASE WHEN end_ms - start_ms >= 500 THEN 1 ELSE 0 END) OVER (PARTITION BY result_id ORDER BY seg_no, segment_id ROWS UNBOUNDED PRECEDING), 1) AS piece_no
      FROM seg WHERE result_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL) GROUP BY result_id, piece_no"""
    sql["card_runs"] = f"""WITH {CARD}, {CHANGES} SELECT media_id, run_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_cards, any_value(text) AS text FROM (
      SELECT *, sum(is_change) OVER (PARTITION BY media_id ORDER BY start_ms, card_id ROWS UNBOUNDED PRECEDING) AS run_no FROM chg) GROUP BY media_id, run_no"""
    sql["change_points"] = f"WITH {CARD}, {CHANGES} SELECT media_id, count(*) FILTER (WHERE is_change = 1) AS n_changes FROM chg GROUP BY media_id"
    sql["score_peaks"] = f"""WITH {CARD} SELECT card_id FROM (SELECT card_id, coalesce(ocr_confidence, 0.0) AS s, lag(coalesce(ocr_confidence, 0.0)) OVER w AS b, lead(coalesce(ocr_confidence, 0.0)) OVER w AS n
      FROM card WHERE media_id IS NOT NULL AND start_ms IS NOT NULL WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, card_id)) WHERE s >= 0.9 AND s > coalesce(b, -1.0) AND s >= coalesce(n, -1.0)"""
    kinds = " UNION ALL ".join(
        [f"SELECT CAST(doc_id AS VARCHAR) AS path, 'suffix' AS failure FROM documents WHERE regexp_matches(lower(CAST(doc_id AS VARCHAR)), {q(r'\.(' + '|'.join(FORBIDDEN_SUFFIXES) + ')$')})"]
        + [f"SELECT CAST(doc_id AS VARCHAR), 'name' FROM documents WHERE CAST(doc_id AS VARCHAR) IN ({', '.join(map(q, FORBIDDEN_NAMES))})"]
        + [f"SELECT CAST(doc_id AS VARCHAR), {q(k)} FROM documents WHERE regexp_matches(text, {q(p)})" for k, p in FORBIDDEN.items()]
    )
    sql["forbidden_content"] = kinds
    sql["lines_without_evidence"] = """SELECT path, count(*) AS n_lines FROM (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_kind = 'note')
      WHERE trim(line) <> '' AND NOT contains(line, '#') GROUP BY path"""
    sql["asset_counts"] = """SELECT path, count(*) FILTER (WHERE trim(line) <> '' AND ltrim(line) NOT LIKE '#%') AS n_entries FROM (
      SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_kind = 'note') GROUP BY path"""
    sql["manifest_check"] = """SELECT CAST(result_id AS VARCHAR) AS path, 'malformed' AS failure FROM results WHERE text IS NULL
      UNION ALL SELECT CAST(result_id AS VARCHAR), 'missing' FROM results WHERE text IS NULL OR punct_mode IS NULL OR punct_mode = 'none'"""
    sql["segment_gaps"] = f"WITH {SEG}, {GAPS} SELECT * FROM gaps"
    sql["retry_windows"] = f"""WITH {SEG}, {GAPS} SELECT result_id, gap_start_ms, least(gap_end_ms, gap_start_ms + 60000) AS gap_end_ms, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY gap_ms DESC, gap_start_ms) AS rank FROM gaps) WHERE rank <= 5"""
    sql["interval_coverage"] = f"""WITH {SEG}, dur AS (SELECT media_id, CAST(round(duration_s * 1000) AS BIGINT) AS duration_ms FROM media),
      clip AS (SELECT seg.media_id, segment_id AS id, greatest(start_ms, 0) AS start_ms, CASE WHEN duration_ms > 0 THEN least(end_ms, duration_ms) ELSE end_ms END AS end_ms FROM seg JOIN dur ON seg.media_id = dur.media_id
      WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL), {_union("c", "media_id", "clip")}
      SELECT dur.media_id, coalesce(covered_ms, 0) AS covered_ms, duration_ms, coalesce(covered_ms, 0) / CASE WHEN duration_ms > 0 THEN duration_ms END AS coverage FROM dur LEFT JOIN c ON dur.media_id = c.media_id"""
    sql["coverage_repair"] = f"""WITH {SEG}, {CHUNK}, a AS (SELECT result_id, segment_id AS id, start_ms, end_ms FROM seg), b AS (SELECT * FROM a UNION ALL SELECT result_id, chunk_id, start_ms, end_ms FROM chunk),
      {_union("x", "result_id", "a")}, {_union("y", "result_id", "b")} SELECT y.result_id, coalesce(x.covered_ms, 0) AS before_ms, y.covered_ms AS after_ms FROM y LEFT JOIN x ON x.result_id = y.result_id"""
    sql["cards_over_segments"] = f"""WITH {SEG}, {CARD} SELECT card_id, count(*) AS n_segments, sum(least(c.end_ms, s.end_ms) - greatest(c.start_ms, s.start_ms)) AS overlap_ms
      FROM card c JOIN seg s ON c.media_id = s.media_id AND c.start_ms <= s.end_ms AND s.start_ms <= c.end_ms WHERE c.end_ms >= c.start_ms AND s.end_ms >= s.start_ms GROUP BY card_id"""
    sql["frame_alignment"] = f"WITH {SEG}, {CARD}, {NEAR} SELECT card_id, segment_id, delta_ms FROM near"
    sql["timeline_offset"] = f"""WITH {SEG}, {CARD}, {NEAR} SELECT c.media_id, count(near.segment_id) AS matched, count(*) AS considered, median(delta_ms) AS median_ms, max(delta_ms) AS max_ms
      FROM card c LEFT JOIN near ON near.card_id = c.card_id WHERE c.media_id IS NOT NULL AND c.start_ms IS NOT NULL GROUP BY c.media_id"""
    sql["window_means"] = f"""WITH {SEG}, {CARD}, j AS (SELECT card_id, count(*) AS n, sum(CAST(round(no_speech_prob * 1000000) AS BIGINT)) AS s FROM card c JOIN seg ON c.media_id = seg.media_id
      AND c.start_ms <= seg.end_ms AND seg.start_ms <= c.end_ms WHERE c.end_ms >= c.start_ms AND seg.end_ms >= seg.start_ms AND no_speech_prob IS NOT NULL GROUP BY card_id)
      SELECT card.card_id, coalesce(n, 0) AS n, s / n / 1000000 AS mean FROM card LEFT JOIN j ON j.card_id = card.card_id"""
    sql["sliced_segments"] = f"WITH {SEG} SELECT segment_id, greatest(start_ms, 60000) - 60000 AS start_ms, least(end_ms, 120000) - 60000 AS end_ms FROM seg WHERE start_ms < 120000 AND end_ms > 60000"
    sql["audio_routes"] = "SELECT CASE WHEN duration_s > 0 THEN 0 ELSE 27 END AS status_code, count(*) AS n_media FROM media GROUP BY 1"
    sql["chunk_plan"] = """WITH d AS (SELECT media_id, CAST(round(duration_s * 1000) AS BIGINT) AS t FROM media WHERE round(duration_s * 1000) > 0),
      n AS (SELECT media_id, t, CAST(greatest(1, ceil((t - 2000) / 598000.0)) AS INTEGER) AS n FROM d),
      k AS (SELECT media_id, t, CASE WHEN n > 1 AND (t - (n - 1) * 598000) * 4 < 600000 THEN n - 1 ELSE n END AS n FROM n)
      SELECT media_id, CAST(i AS INTEGER) AS chunk_no, i * 598000 AS start_ms, CASE WHEN i = n - 1 THEN t ELSE i * 598000 + 600000 END AS end_ms FROM (SELECT media_id, t, n, unnest(range(n)) AS i FROM k)"""
    sql["chunk_overlaps"] = f"""WITH {CHUNK} SELECT chunk_id, least(greatest(start_ms, coalesce(u, start_ms)), greatest(end_ms, start_ms)) AS kept_from_ms, greatest(0, least(coalesce(u, start_ms), end_ms) - start_ms) AS overlap_ms, coalesce(u >= end_ms, false) AS is_repeat FROM (
      SELECT *, max(end_ms) OVER (PARTITION BY result_id ORDER BY chunk_no, start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM chunk WHERE result_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL)"""
    sql["completeness_report"] = f"""WITH {CARD}, {CHANGES}, i AS (SELECT media_id, card_id AS id, start_ms, end_ms FROM card), {_union("c", "media_id", "i")},
      n AS (SELECT media_id, count(*) AS n_cards, count(*) FILTER (WHERE end_ms - start_ms < 500) AS n_short FROM card WHERE media_id IS NOT NULL GROUP BY media_id),
      g AS (SELECT media_id, sum(is_change) AS n_changes FROM chg GROUP BY media_id)
      SELECT n.media_id, n_cards, n_short, n_changes, covered_ms FROM n LEFT JOIN g ON g.media_id = n.media_id LEFT JOIN c ON c.media_id = n.media_id"""
    sql["resegmented"] = rf"""WITH {SEG}, p AS (SELECT segment_id, start_ms, end_ms, length(text) AS n, regexp_extract_all(text, '(?s)[^。！？!?]{{0,27}}[。！？!?]|[^。！？!?]{{1,28}}') AS a FROM seg WHERE text <> ''),
      u AS (SELECT segment_id, start_ms, end_ms, n, a, unnest(range(len(a))) AS i FROM p),
      o AS (SELECT segment_id, start_ms, end_ms, n, i, a[i + 1] AS text, coalesce(list_sum(list_transform(a[1:i], lambda x: length(x))), 0) AS b FROM u)
      SELECT segment_id, CAST(i AS INTEGER) AS piece_no, start_ms + CAST(floor((end_ms - start_ms) * b / n) AS BIGINT) AS start_ms, start_ms + CAST(floor((end_ms - start_ms) * (b + length(text)) / n) AS BIGINT) AS end_ms, text FROM o"""
    sql["pause_punctuation"] = f"""WITH {SEG}, w AS (SELECT segment_id, text, lead(start_ms) OVER w - end_ms AS pause_ms, lead(segment_id) OVER w IS NULL AS is_last, coalesce(regexp_matches(lead(text) OVER w, {q(_GOES)}), false) AS goes
      FROM seg WHERE result_id IS NOT NULL WINDOW w AS (PARTITION BY result_id ORDER BY seg_no, segment_id)),
      m AS (SELECT *, CASE WHEN regexp_matches(text, '(?:吗|呢|么)$') THEN '？' ELSE '。' END AS stop FROM w)
      SELECT segment_id, pause_ms, CASE WHEN text IS NULL OR trim(text) = '' OR regexp_matches(text, {q(_MARK_END)}) THEN '' WHEN is_last OR pause_ms >= 1200 THEN stop
      WHEN pause_ms IS NULL OR pause_ms < 100 THEN '' WHEN pause_ms >= 600 AND NOT goes THEN stop ELSE '，' END AS mark FROM m"""
    sql["topic_chunks"] = f"""WITH {SEG}, r AS (SELECT result_id, coalesce(length(text), 0) AS n, coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY result_id ORDER BY seg_no, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
      FROM seg WHERE result_id IS NOT NULL) SELECT result_id, CAST(floor(b / 600) AS BIGINT) AS chunk_no, count(*) AS n_segments, sum(n) AS n_chars FROM r GROUP BY 1, 2"""
    sql["fused_transcript"] = f"WITH {SEG}, {CARD}, {FUSED} SELECT * FROM fused"
    sql["provenance_counts"] = f"WITH {SEG}, {CARD}, {FUSED} SELECT provenance, count(*) AS n, count(*) FILTER (WHERE needs_review) AS n_review FROM fused GROUP BY provenance"
    near1 = NEAR.replace("5000", "1000")
    pair = f"WITH {SEG}, {CARD}, {near1}, p AS (SELECT c.card_id, c.media_id, c.text AS ref, s.text AS hyp FROM near JOIN card c ON c.card_id = near.card_id JOIN seg s ON s.segment_id = near.segment_id)"
    sql["card_alignment_sums"] = f"""{pair} SELECT media_id, count(*) AS n_pairs, sum(length(ref)) AS ref_chars, sum(length(hyp)) AS hyp_chars, sum(length(ref)) AS accounted
      FROM p WHERE ref IS NOT NULL AND hyp IS NOT NULL GROUP BY media_id"""
    sql["difference_rebuilt"] = f"{pair} SELECT card_id, md5(ref) AS text_md5 FROM p WHERE ref <> hyp"
    sql["preferred_examples"] = """SELECT * FROM (VALUES (1, '赡养老人', '赠养→赡养'), (2, '赡养老人', '赠养→赡养'), (3, '我已经去了', '以经→已经'), (4, '再见朋友', '在见→再见'), (5, '同样', NULL), (6, '做为人', NULL), (7, '没有冲突', NULL))
      AS t(case_id, text, chosen_by)"""
    sql["conserved_chars"] = f"""WITH {SEG}, {CARD}, b AS (SELECT media_id, start_ms, end_ms, text FROM card UNION ALL SELECT media_id, start_ms, end_ms, text FROM seg)
      SELECT media_id, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS n_missing FROM b WHERE media_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms >= start_ms GROUP BY media_id"""
    sql["source_priority"] = f"""WITH {SEG}, {CARD} SELECT media_id, 'card' AS source, count(*) AS n FROM card WHERE media_id IS NOT NULL GROUP BY media_id
      UNION ALL SELECT media_id, 'asr', count(*) FROM seg WHERE media_id IS NOT NULL AND media_id NOT IN (SELECT media_id FROM card WHERE media_id IS NOT NULL) GROUP BY media_id"""
    sql["lexicon_terms"] = r"""WITH t AS (SELECT trim(unnest([name_zh, name_en, other_name])) AS term, 0 AS priority FROM speakers
      UNION ALL SELECT unnest(regexp_extract_all(title, '[A-Za-z][A-Za-z]+')), 1 FROM media),
      b AS (SELECT term, min(priority) AS priority FROM t WHERE length(term) >= 2 AND lower(term) NOT IN ('the', 'of', 'and') GROUP BY term)
      SELECT term, priority, row_number() OVER (ORDER BY priority, term) AS rank FROM b QUALIFY rank <= 200"""
    # levenshtein counts bytes here, so each pair is spelt in bytes first: one for every character both texts have, one
    # for all that only the first has, one for all that only the second has; none of these ever match.
    spell = "array_to_string(list_transform(string_split({0}, ''), lambda x: chr(coalesce(nullif(list_position(common, x), 0), {1}))), '')"
    distances = f"""WITH {SEG}, n AS (SELECT segment_id, result_id, text AS a, lag(text) OVER (PARTITION BY result_id ORDER BY seg_no, segment_id) AS b FROM seg WHERE result_id IS NOT NULL),
      c AS (SELECT *, list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, ''))) AS common FROM n WHERE a IS NOT NULL AND b IS NOT NULL),
      e AS (SELECT segment_id, result_id, a, b, CASE WHEN a = b THEN 0 WHEN a = '' OR b = '' THEN length(a) + length(b) WHEN len(common) > 125 THEN error('more common characters than bytes')
        ELSE levenshtein({spell.format("a", 126)}, {spell.format("b", 127)}) END AS distance FROM c)"""
    sql["edit_distances"] = f"{distances} SELECT segment_id, distance FROM e"
    sql["edit_rates"] = f"{distances} SELECT result_id, count(*) AS n_pairs, sum(distance) / nullif(sum(length(b)), 0) AS edit_rate FROM e GROUP BY result_id"
    sql["repeated_ngrams"] = f"""WITH {SEG}, c AS (SELECT segment_id, text, unnest(range(1, length(text) - 2)) AS i FROM seg WHERE text IS NOT NULL),
      g AS (SELECT segment_id, string_agg_free AS gram, count(*) AS n FROM (SELECT segment_id, substring(text, i, 4) AS string_agg_free FROM c) GROUP BY 1, 2)
      SELECT segment_id, max(n) AS repeats FROM g GROUP BY segment_id HAVING max(n) >= 3"""
    sql["char_overlap"] = f"""WITH {CHUNK}, p AS (SELECT chunk_id, chunk.text AS a, results.text AS b FROM chunk JOIN results ON chunk.result_id = results.result_id WHERE chunk.text IS NOT NULL AND results.text IS NOT NULL),
      x AS (SELECT chunk_id, c, count(*) AS n FROM (SELECT chunk_id, unnest(string_split(a, '')) AS c FROM p) WHERE c <> '' GROUP BY ALL), y AS (SELECT chunk_id, c, count(*) AS n FROM (SELECT chunk_id, unnest(string_split(b, '')) AS c FROM p) WHERE c <> '' GROUP BY ALL),
      z AS (SELECT x.chunk_id, sum(least(x.n, y.n)) AS s FROM x JOIN y ON x.chunk_id = y.chunk_id AND x.c = y.c GROUP BY 1)
      SELECT p.chunk_id, coalesce(s, 0) AS n_shared, length(a) AS n_chars FROM p LEFT JOIN z ON z.chunk_id = p.chunk_id"""
    sql["hallucination_gate"] = f"""WITH {SEG}, c AS (SELECT segment_id, text, unnest(range(1, length(text) - 2)) AS i FROM seg WHERE text IS NOT NULL),
      g AS (SELECT segment_id, max(n) AS n FROM (SELECT segment_id, substring(text, i, 4) AS gram, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
      r AS (SELECT seg.segment_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN compression_ratio > 2.4 THEN 'compression' WHEN n >= 3 THEN 'repetition'
      WHEN end_ms > start_ms AND (length(text) * 1000 / (end_ms - start_ms) < 0.5 OR length(text) * 1000 / (end_ms - start_ms) > 8.0) THEN 'rate' END AS reject_reason FROM seg LEFT JOIN g ON g.segment_id = seg.segment_id)
      SELECT segment_id, reject_reason FROM r WHERE reject_reason IS NOT NULL"""
    sql["refine_candidates"] = f"""WITH {SEG} SELECT result_id, segment_id, rank FROM (SELECT result_id, segment_id, row_number() OVER (PARTITION BY result_id ORDER BY coalesce(avg_logprob, 0.0), start_ms, segment_id) AS rank
      FROM seg WHERE result_id IS NOT NULL AND (avg_logprob < -1.0 OR compression_ratio > 2.4) AND end_ms - start_ms >= 1500) WHERE rank <= 6"""
    sql["run_summary"] = f"""WITH {SEG}, p AS (SELECT result_id, count(*) AS n_segments, sum(length(text)) AS n_chars FROM seg WHERE result_id IS NOT NULL GROUP BY result_id)
      SELECT r.result_id, n_segments, n_chars, coalesce(len(diagnostics), 0) AS n_steps, elapsed * 1000 / CASE WHEN round(duration_s * 1000) > 0 THEN round(duration_s * 1000) END AS rtf
      FROM results r LEFT JOIN p ON p.result_id = r.result_id LEFT JOIN media m ON m.media_id = r.media_id"""
    sql["history_trend"] = f"""WITH {HIST} SELECT "case", norm, count(*) AS runs, arg_min(elapsed, row(created_at, result_id)) AS first, arg_max(elapsed, row(created_at, result_id)) AS last, min(created_at) AS first_at, max(created_at) AS last_at
      FROM h WHERE created_at IS NOT NULL AND elapsed IS NOT NULL GROUP BY "case", norm"""
    sql["history_latest"] = f"""WITH {HIST} SELECT "case", norm, created_at, result_id, elapsed FROM h WHERE created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "case", norm ORDER BY created_at DESC, result_id DESC) = 1"""
    sql["trend_regressions"] = f"""WITH {HIST} SELECT "case", norm, previous, last FROM (SELECT "case", norm, elapsed AS last, lag(elapsed) OVER w AS previous, row_number() OVER (PARTITION BY "case", norm ORDER BY created_at DESC, result_id DESC) AS r
      FROM h WHERE created_at IS NOT NULL AND elapsed IS NOT NULL WINDOW w AS (PARTITION BY "case", norm ORDER BY created_at, result_id)) WHERE r = 1 AND last - previous > 0.005"""
    sql["baseline_gate"] = f"""WITH {HIST}, t AS (SELECT "case", norm, count(*) AS runs, arg_min(elapsed, row(created_at, result_id)) AS f, arg_max(elapsed, row(created_at, result_id)) AS l FROM h
      WHERE "case" IS NOT NULL AND norm IS NOT NULL AND created_at IS NOT NULL AND elapsed IS NOT NULL GROUP BY 1, 2)
      SELECT "case", norm, CASE WHEN runs = 1 THEN 'unrecorded' WHEN l - f > 0.005 THEN 'regressed' WHEN l - f < 0 THEN 'improved' ELSE 'held' END AS verdict FROM t"""
    sql["threshold_gate"] = f"WITH {HIST} SELECT count(*) AS n_cases, count(*) FILTER (WHERE coalesce(elapsed > 60.0, true)) AS n_over, count(*) FILTER (WHERE coalesce(elapsed > 60.0, true)) = 0 AS passed FROM h"
    sql["release_rows"] = f"""WITH {HIST}, n AS (SELECT "case", norm, elapsed, count(*) OVER (PARTITION BY "case", norm) AS k, row_number() OVER (PARTITION BY "case", norm ORDER BY created_at DESC, result_id DESC) AS r
      FROM h WHERE "case" IS NOT NULL AND norm IS NOT NULL AND created_at IS NOT NULL) SELECT "case", norm, elapsed, '1.2.0' AS version FROM n WHERE r = 1 AND k <= 2"""
    sql["worksheet_flags"] = f"""WITH {SEG}, f AS (SELECT result_id, segment_id, CASE WHEN compression_ratio > 2.4 THEN 0 WHEN avg_logprob < -1.0 THEN 1 WHEN no_speech_prob > 0.6 THEN 2 WHEN text IS NULL THEN 3 END AS w FROM seg WHERE result_id IS NOT NULL),
      c AS (SELECT *, greatest(8, floor(count(*) OVER (PARTITION BY result_id) * 0.3)) AS most, count(w) OVER (PARTITION BY result_id) AS flagged_total FROM f)
      SELECT result_id, segment_id, ['repetition', 'low_confidence', 'no_speech', 'no_text'][w + 1] AS reason, rank, flagged_total FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY w, segment_id) AS rank FROM c WHERE w IS NOT NULL) WHERE rank <= most"""
    sql["lowest_decile"] = f"""WITH {SEG}, p AS (SELECT result_id, segment_id, avg_logprob, quantile_disc(avg_logprob, 0.1) OVER (PARTITION BY result_id) AS q FROM seg WHERE result_id IS NOT NULL AND avg_logprob IS NOT NULL)
      SELECT result_id, segment_id, avg_logprob FROM p WHERE avg_logprob <= q"""
    sql["review_decisions"] = """SELECT doc_id, count(is_harmful) AS n_votes, CASE WHEN min(is_harmful) <> max(is_harmful) THEN 'unresolved' WHEN max(is_harmful) = 1 THEN 'correct' WHEN max(is_harmful) = 0 THEN 'keep' END AS decision FROM doc_reviews GROUP BY doc_id"""
    clock = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
    sql["srt_cues"] = f"""WITH {SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY seg_no, segment_id) AS cue_no FROM seg WHERE result_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL)
      SELECT result_id, cue_no, CAST(cue_no AS VARCHAR) || chr(10) || {clock.format("start_ms")} || ' --> ' || {clock.format("end_ms")} || chr(10) || coalesce(text, '') || chr(10) AS cue FROM n"""
    sql["plain_text"] = f"""WITH {SEG} SELECT result_id, CAST(floor(seg_no / 256) AS BIGINT) AS part_no, string_agg(coalesce(text, ''), '' ORDER BY seg_no, segment_id) AS text FROM seg WHERE result_id IS NOT NULL GROUP BY 1, 2"""
    sql["media_notes"] = """SELECT media_id, concat_ws(chr(10), '---' || chr(10) || concat_ws(chr(10), 'source: ' || media_id, 'platform: ' || platform, 'lang: ' || lang) || chr(10) || '---' || chr(10),
      '# ' || coalesce(title, 'untitled') || chr(10), CASE WHEN coalesce(uploader, '') <> '' THEN '## Uploader' || chr(10) || chr(10) || uploader END) AS note FROM media"""
    sql["vault_index"] = "SELECT coalesce(platform, 'unsorted') AS topic, count(*) AS n_pages, min(media_id) AS first_page FROM media GROUP BY 1"
    labels = ", ".join(f"({q(k)}, {q(v)})" for k, v in STEP_LABELS.items())
    sql["processing_sections"] = f"""WITH l(step, label) AS (VALUES {labels}), s AS (SELECT DISTINCT result_id, unnest(diagnostics) AS step FROM results)
      SELECT result_id, '| Step |' || chr(10) || '| --- |' || chr(10) || string_agg('| ' || label || ' |', chr(10) ORDER BY label) AS section FROM s JOIN l ON l.step = s.step GROUP BY result_id"""
    flat = r"regexp_replace(regexp_replace(coalesce({0}, ''), '\t', ' ', 'g'), '\r?\n', '<br>', 'g')"
    sql["anki_export"] = f"WITH {CARD} SELECT {flat.format('text')} || chr(9) || {flat.format('media_id')} || chr(9) || 'card' AS value FROM card"
    sql["event_sessions"] = """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n_events FROM s GROUP BY user_id, k"""
    sql["event_windows"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"
    sql["baselines_by_mode"] = f"""WITH {HIST}, m AS (SELECT "case", norm, min(elapsed) AS e FROM h WHERE "case" IS NOT NULL AND norm IS NOT NULL GROUP BY 1, 2)
      SELECT "case", string_agg(norm || '=' || coalesce(CAST(CAST(round(e * 1000) AS BIGINT) AS VARCHAR), '?'), ',' ORDER BY norm || '=' || coalesce(CAST(CAST(round(e * 1000) AS BIGINT) AS VARCHAR), '?')) AS modes FROM m GROUP BY 1"""
    sql["gate_by_mode"] = f"""WITH {HIST}, m AS (SELECT "case", norm, min(elapsed) AS best FROM h WHERE "case" IS NOT NULL AND norm IS NOT NULL GROUP BY 1, 2),
      n AS (SELECT "case", norm, elapsed FROM h WHERE "case" IS NOT NULL AND norm IS NOT NULL AND created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "case", norm ORDER BY created_at DESC, result_id DESC) = 1)
      SELECT n."case", n.norm, CASE WHEN best IS NULL THEN 'unrecorded' WHEN elapsed IS NULL OR elapsed - best > 0.005 THEN 'regressed' WHEN elapsed < best THEN 'improved' ELSE 'held' END AS verdict FROM n LEFT JOIN m ON m."case" = n."case" AND m.norm = n.norm"""
    sql["matched_cases"] = f"""WITH {CARD}, g AS (SELECT media_id, min(text) AS ref FROM card WHERE media_id IS NOT NULL GROUP BY 1)
      SELECT 'cases/' || r.media_id || '.json' AS "case", count(*) AS n_hyps, CAST(max(length(ref)) AS INTEGER) AS ref_chars FROM results r LEFT JOIN g ON g.media_id = r.media_id WHERE r.media_id IS NOT NULL GROUP BY 1"""
    sql["link_examples"] = """SELECT * FROM (VALUES (1, 'BV1xx411c7mD', 'bilibili'), (2, 'av170001', 'bilibili'), (3, 'dy7123456789012345678', 'douyin'), (4, 'short:aBcD12', 'douyin'), (5, NULL, NULL), (6, NULL, NULL))
      AS t(case_id, canonical_id, source_platform)"""
    sql["redaction_examples"] = """SELECT * FROM (VALUES (1, '[cookie]; x'), (2, '[token] end'), (3, '[signed-url] ok'), (4, 'in [home]/x and [tmp]'), (5, '[home]' || chr(92) || 'x'), (6, 'plain'), (7, NULL)) AS t(case_id, redacted)"""
    sql["forbidden_examples"] = """SELECT * FROM (VALUES ('a/v.mp4', 'suffix'), ('b/.env', 'name'), ('c/t.md', 'loopback_address'), ('d/k.md', 'credential'), ('e/p.md', 'machine_path'), ('e/p.md', 'credential')) AS t(path, failure)"""
    sql["failures_by_type"] = "SELECT * FROM (VALUES (1, 21), (2, 22), (3, 22), (4, 21), (5, 0), (6, 1), (7, 27), (8, 26)) AS t(case_id, status_code)"
    kept = "list_extract(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '^\\x{FEFF}', ''), '\\n[ \\t]*\\n+'), 1)"
    sql["srt_round_trip"] = f"""WITH {SEG} SELECT segment_id, start_ms, end_ms, regexp_replace(regexp_replace({kept}, '<[^<>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text
      FROM seg WHERE result_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL"""
    sql["wrapped_lines"] = f"""WITH {SEG}, l AS (SELECT segment_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM seg WHERE text IS NOT NULL),
      w AS (SELECT segment_id, k, CASE WHEN line = '' THEN '' ELSE array_to_string(list_transform(range(0, length(line), 18), lambda i: substring(line, i + 1, 18)), chr(10)) END AS line FROM l)
      SELECT segment_id, string_agg(line, chr(10) ORDER BY k) AS lines FROM w GROUP BY segment_id"""
    sql["cues_over_limit"] = f"WITH {SEG} SELECT count(*) AS n_cues, count(*) FILTER (WHERE length(text) > 28) AS cues_over_limit FROM seg"
    sql["loud_retries"] = f"""WITH {SEG}, {GAPS} SELECT result_id, gap_start_ms, least(gap_end_ms, gap_start_ms + 60000) AS gap_end_ms, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY gap_ms DESC, gap_start_ms) AS rank FROM gaps WHERE gap_ms >= 4000) WHERE rank <= 5"""
    sql["asked_parts"] = f"WITH {CHUNK} SELECT chunk_id, chunk_no + 1 AS part FROM chunk WHERE result_id IS NOT NULL AND chunk_no IS NOT NULL"
    sql["inspected_media"] = """SELECT media_id, CASE WHEN media_id LIKE 'bl-%' THEN 'bilibili' WHEN media_id LIKE 'dy-%' THEN 'douyin' WHEN media_id LIKE 'lf-%' THEN 'local' END AS source_platform,
      CASE WHEN media_id LIKE 'dy-%' THEN 'subtitles,comments' ELSE '' END AS refused FROM media"""
    sql["templated_notes"] = "SELECT media_id, CASE platform WHEN 'bilibili' THEN '# B' WHEN 'douyin' THEN '# D' ELSE '# plain' END AS body, platform IS NULL OR platform NOT IN ('bilibili', 'douyin') AS is_builtin FROM media"
    sql["section_updates"] = """SELECT media_id, '---' || chr(10) || concat_ws(chr(10), 'source: ' || media_id, 'platform: ' || platform, 'lang: ' || lang) || chr(10) || '---' || chr(10) || chr(10)
      || '# ' || coalesce(title, 'untitled') || chr(10) || chr(10) || '## Uploader' || chr(10) || chr(10) || 'someone' || chr(10) AS note FROM media"""
    sql["frontmatter_names"] = """SELECT 'vault/' || f || '/NOTE.md' AS path, media_id AS value FROM (SELECT media_id, CASE WHEN length(media_id) % 3 = 0 THEN coalesce(platform, 'none') ELSE media_id END AS f FROM media) WHERE f <> media_id"""
    sql["differing_copies"] = "SELECT media_id AS name, count(*) AS n_copies, count(DISTINCT text) AS n_versions FROM results WHERE media_id IS NOT NULL AND text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT text) > 1"
    sql["entrypoints"] = "SELECT 'root/' || engine || '/SKILL.md' AS path, count(*) AS n FROM results WHERE NOT chunked AND diarized GROUP BY 1"
    sql["declared_versions"] = """WITH m AS (SELECT media_id AS path, CAST(count(DISTINCT CASE WHEN diarized THEN model_size END) AS INTEGER) AS n_versions FROM results WHERE media_id IS NOT NULL GROUP BY 1)
      SELECT path, n_versions, CASE WHEN n_versions = 0 THEN 'missing' ELSE 'contradictory' END AS failure FROM m WHERE n_versions <> 1"""
    sql["version_parity"] = "SELECT count(model_size) AS n_declared, count(DISTINCT regexp_replace(model_size, '^v', '')) AS n_versions, count(DISTINCT regexp_replace(model_size, '^v', '')) <= 1 AS agreed FROM results"
    sql["host_parity"] = """WITH r AS (SELECT engine, min(device) AS device, max(compute_type) AS compute_type, CAST(count(*) AS VARCHAR) AS n_runs FROM results GROUP BY 1),
      t AS (SELECT engine, unnest(['device', 'compute_type', 'n_runs']) AS key, unnest([device, compute_type, n_runs]) AS value FROM r), w AS (SELECT * FROM t WHERE engine = (SELECT min(engine) FROM r))
      SELECT t.engine AS host, t.key, t.value, w.value AS expected FROM t JOIN w ON w.key = t.key WHERE t.engine <> w.engine AND t.value IS DISTINCT FROM w.value"""
    sql["unreferenced_names"] = """WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents), n AS (SELECT w, count(*) AS n FROM w GROUP BY 1)
      SELECT speaker_code AS name FROM speakers LEFT JOIN n ON n.w = speaker_code WHERE coalesce(n.n, 0) <= 1"""
    sql["topic_parts"] = """SELECT platform, count(*) AS n_lines, CAST(sum(length(replace('- [[' || media_id || ']] ' || coalesce(title, 'untitled'), chr(10), ''))) AS BIGINT) AS n_chars FROM media WHERE platform IS NOT NULL GROUP BY 1"""
    sql["live_trend"] = f"""WITH {HIST} SELECT "case", norm, count(*) AS runs FROM h WHERE "case" IS NOT NULL AND created_at IS NOT NULL AND elapsed IS NOT NULL GROUP BY 1, 2"""
    for name, types in _TYPES.items():
        sql[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in types.items())}) FROM ({sql[name]})"
    return sql
