"""DuckDB SQL for the rows of the queries."""

from __future__ import annotations

from tapeloom.functions.redact import MONTHS, STREETS
from tapeloom.plans.queries import LISTED, ORDERED, PERSONAL, WRAPPED

EV = """ev AS (SELECT event_id, user_id AS media_id, event_type, value, props, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS ts_s FROM events)"""
FRAMES = EV + """,
fr AS (SELECT media_id, ts_s, 'shots\\img_' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS image, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS src_no, value / 100 AS scene_score FROM ev WHERE event_type IN ('view', 'click'))"""


def _ts(x: str) -> str:
    s = f"greatest({x}, 0.0)"
    whole = f"CAST(floor({s}) AS BIGINT)"
    return f"printf('%02d:%02d.%d', ({whole} % 3600) // 60, {whole} % 60, CAST(floor(({s} - floor({s})) * 10 + 1e-9) AS BIGINT))"


def _thin(name: str, rows: str, test: str) -> str:
    """CTEs that keep what passes test(t, last); rows has media_id, ts_s, image, src_no."""
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY ts_s, src_no, image) AS i FROM {rows}),
{name}_r AS (SELECT media_id, ts_s, image, src_no, i, true AS kept, ts_s AS last FROM {name}_n WHERE i = 1
  UNION ALL SELECT n.media_id, n.ts_s, n.image, n.src_no, n.i, {test}, CASE WHEN {test} THEN n.ts_s ELSE r.last END FROM {name}_r r JOIN {name}_n n ON n.media_id = r.media_id AND n.i = r.i + 1),
{name} AS (SELECT media_id, ts_s, image, src_no FROM {name}_r WHERE kept)"""


STEPS = f"""{FRAMES}, views AS (SELECT * FROM fr WHERE src_no = 0), {_thin("kept", "views", "n.ts_s - r.last >= 3600")},
st AS (SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY ts_s, src_no, image) AS INTEGER) AS step, ts_s, {_ts("ts_s")} AS ts, replace(image, '\\', '/') AS image FROM kept),
sp AS (SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY ts_s, event_id) AS INTEGER) AS seg_no, ts_s AS start_s, ts_s + value AS end_s, (ts_s + (ts_s + value)) / 2.0 AS mid, event_type AS text FROM ev WHERE event_type = 'error'),
ls AS (SELECT media_id, max(ts_s) AS last_ts, max(step) AS last_step FROM st GROUP BY media_id),
tl AS (SELECT sp.*, CAST(floor(mid / 86400.0) AS BIGINT) AS bucket, last_step FROM sp JOIN ls USING (media_id) WHERE mid > last_ts),
tb AS (SELECT media_id, bucket, CAST(any_value(last_step) + row_number() OVER (PARTITION BY media_id ORDER BY bucket) AS INTEGER) AS step, min(start_s) AS ts_s FROM tl GROUP BY media_id, bucket),
ex AS (SELECT media_id, step, ts_s, {_ts("ts_s")} AS ts, '' AS image FROM tb),
late AS (SELECT media_id, step, CAST(seg_no AS BIGINT) AS seg_no FROM tl JOIN tb USING (media_id, bucket)),
wi AS (SELECT sp.* FROM sp JOIN ls USING (media_id) WHERE mid <= last_ts),
pv AS (SELECT s.media_id, coalesce((SELECT max(step) FROM st WHERE st.media_id = s.media_id AND st.ts_s <= s.mid), 1) AS step, CAST(seg_no AS BIGINT) AS seg_no FROM wi s),
nr AS (SELECT s.media_id, (SELECT arg_min(step, (abs(s.mid - st.ts_s), st.ts_s, step)) FROM st WHERE st.media_id = s.media_id) AS step, CAST(seg_no AS BIGINT) AS seg_no FROM wi s),
al AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY ts_s, is_extra, step) AS place FROM (SELECT *, 0 AS is_extra FROM st UNION ALL SELECT *, 1 FROM ex))"""

IMAGES = EV + """, im AS (SELECT media_id, 'img_' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS image FROM ev WHERE event_type = 'click'),
ln AS (SELECT media_id, event_id AS line_no, CASE WHEN event_type = 'view' THEN '[showinfo] n:' ELSE '[other] n:' END || event_id || CASE WHEN event_id % 5 = 0 THEN ' pts:' ELSE ' pts_time:' END || (event_id % 1000) || '.' || (event_id % 10) || ' pts_time:7' AS line FROM ev),
tm AS (SELECT media_id, line_no, CAST(regexp_extract(line, 'pts_time:([0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) AS ts_s FROM ln WHERE contains(line, 'showinfo')),
iv AS (SELECT media_id, image, (i - 1) * 2.0::DOUBLE AS ts_s FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY image) AS i FROM im) WHERE i <= 10)"""
SCENE = """sc AS (SELECT media_id, ts_s, image, scene_score FROM fr WHERE scene_score > 0.45 QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY ts_s, src_no, image) <= 20)"""
UNION = IMAGES + ", " + FRAMES.split(",\n", 1)[1] + ", " + SCENE + """,
s0 AS (SELECT DISTINCT user_id AS media_id, 0.0::DOUBLE AS ts_s, 'start' AS image, 'start' AS src, 0 AS src_no FROM events),
s1 AS (SELECT media_id, ts_s, image, 'scene' AS src, 1 AS src_no FROM sc), s2 AS (SELECT media_id, ts_s, image, 'interval' AS src, 2 AS src_no FROM iv)"""

SENTENCES = """p AS (SELECT conv_id AS media_id, turn, unnest(string_split(text, '.')) AS raw, generate_subscripts(string_split(text, '.'), 1) AS i FROM conversations),
q AS (SELECT media_id, turn, i, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS text FROM p),
w AS (SELECT *, len(string_split(text, ' ')) AS n FROM q WHERE text <> ''),
sg AS (SELECT media_id, row_number() OVER o AS seg_no, 0.25::DOUBLE * (sum(n) OVER o - n) AS start_s, 0.25::DOUBLE * sum(n) OVER o AS end_s, text, n FROM w WINDOW o AS (PARTITION BY media_id ORDER BY turn, i ROWS UNBOUNDED PRECEDING))"""

#: Pass, label, pattern, the group that is the hit, and what stays of the match. RE2 has no look-around.
PASSES = [
    (1, "EMAIL", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", 0, ""),
    (2, "PHONE", r"(^|\W)((?:\+?1[\s.-]?)?(?:\(\s*\d{3}\s*\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4})\b", 2, r"\1"),
    (3, "SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0, ""),
    (4, "CARD", r"\b(?:\d[ -]*?){13,19}\b", 0, ""),
    (5, "ADDRESS", rf"(?i)\b\d{{1,6}}\s+[A-Za-z0-9.''-]+(?:\s+[A-Za-z0-9.''-]+){{0,4}}\s+(?:{STREETS})\.?\b", 0, ""),
    (6, "ZIP", r"\b\d{5}(?:-\d{4})?\b", 0, ""),
    (7, "DATE", r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{1,2}-\d{1,2})\b", 0, ""),
    (8, "DATE", rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,\s*\d{{4}})?\b", 0, ""),
    (9, "NAME", r"(?i)\b(my name is\s+)([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b", 2, r"\1"),
    (13, "NUM", r"\b\d{4,}\b", 0, ""),
    (14, "NAME", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", 0, ""),
]
LEVEL = {"light": 5, "standard": 9, "heavy": 14}
TERM_PASSES = [(10, "NAME", r"(?i)\bMary Poppins\b", 0, ""), (10, "NAME", r"(?i)\bOak\b", 0, ""), (11, "ORG", r"(?i)\bHi\b", 0, ""), (12, "LOCATION", r"(?i)\bHill\b", 0, "")]


def _of(level: str, terms: bool = False) -> list:
    own = [p for p in PASSES if p[0] <= LEVEL[level]]
    return own + TERM_PASSES if terms else own


def _replaced(x: str, level: str, terms: bool = False) -> str:
    for _, label, pattern, _, keep in _of(level, terms):
        x = f"regexp_replace({x}, '{pattern}', '{keep}[{label}]', 'g')"
    return x


def _hit_ctes(level: str, source: str) -> tuple[str, str]:
    """CTEs t0.. of the text before each pass, and a union of the hits of all passes as (doc_id, pass_no, label, match, start, end)."""
    ctes, unions, key = [f"t0 AS (SELECT doc_id, text FROM ({source}))"], [], "doc_id"
    for i, (no, label, pattern, group, keep) in enumerate(_of(level)):
        ctes.append(f"t{i + 1} AS (SELECT doc_id, regexp_replace(text, '{pattern}', '{keep}[{label}]', 'g') AS text FROM t{i})")
        ctes.append(f"h{i} AS (SELECT {key}, string_split_regex(text, '{pattern}') AS ps, regexp_extract_all(text, '{pattern}') AS fs, regexp_extract_all(text, '{pattern}', {group}) AS ms, unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) AS j FROM t{i})")
        start = "coalesce(list_sum(list_transform(ps[1:j], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(fs[1:j], lambda x: length(x))), 0) - length(ms[j])"
        unions.append(f"SELECT doc_id, CAST({no} AS INTEGER) AS pass_no, '{label}' AS label, ms[j] AS match, CAST({start} AS INTEGER) AS start, CAST({start} + length(ms[j]) AS INTEGER) AS \"end\" FROM h{i}")
    return ", ".join(ctes), " UNION ALL ".join(unions)


def _cleaned(x: str, mode: str) -> str:
    # fixed values: the patterns of the cleaning steps
    steps = [(r"\r\n?", "\n"), (r"[ \t]*\n[ \t]*", "\n"), (r"\A[ \t]+|[ \t]+\z", "")] + [("([^.!?:\\n])\\n([\"''“”‘’]?[a-z])", r"\1 \2")] * 2
    for p, r in [*steps, (r"\n{3,}", "\n\n"), (r"\A\s+|\s+\z", "")]:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    x = f"({x} || chr(10))"
    for p, r in [(r"\s+([,.;:!?])", r"\1"), (r"([,.;:!?])([A-Za-z])", r"\1 \2"), (r"\(\s+", "("), (r"\s+\)", ")")]:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    if mode == "standard":
        x = f"translate({x}, '“”‘’', '\"\"''''')"
    return f"regexp_replace({x}, '[ \\t]{{2,}}', ' ', 'g')"


T2 = PERSONAL.format(S="VARCHAR")
_payload = """CASE event_id % 5 WHEN 0 THEN '[1]' WHEN 1 THEN '{bad' WHEN 2 THEN '{"name": null}' ELSE props END"""
_docs_hits, _t2_hits, _t2_light = _hit_ctes("standard", "SELECT doc_id, text FROM documents"), _hit_ctes("heavy", T2), _hit_ctes("light", T2)

#: One pass for each term over what the passes before left, by kind and length.
_TERMS = f"""t AS (SELECT DISTINCT upper(kind) AS label, trim(term) AS term FROM ({LISTED}) WHERE trim(term) <> ''),
l AS (SELECT list(label || chr(1) || '(?i)\\b' || regexp_escape(term) || '\\b' ORDER BY CASE label WHEN 'NAME' THEN 0 WHEN 'ORG' THEN 1 ELSE 2 END, length(term) DESC, term) AS terms FROM t),
m AS (SELECT doc_id, list_reduce(list_prepend(text, terms), lambda a, x: regexp_replace(a, split_part(x, chr(1), 2), '[' || split_part(x, chr(1), 1) || ']', 'g')) AS text FROM ({ORDERED}), l)"""

ORACLES = {
    "scene_filter": f"WITH {FRAMES}, {SCENE} SELECT * FROM sc",
    "log_extract": f"WITH {IMAGES} SELECT media_id, line_no, ts_s FROM tm",
    "ordinal_zip": f"""WITH {IMAGES}, a AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY image) AS i FROM im), b AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY line_no) AS i FROM tm)
      SELECT media_id, image, b.ts_s FROM a JOIN b USING (media_id, i) UNION ALL SELECT media_id, image, CAST(i - 1 AS DOUBLE) FROM a WHERE media_id NOT IN (SELECT media_id FROM tm)""",
    "interval_frames": f"WITH {IMAGES} SELECT media_id, image, ts_s FROM iv",
    "frames_strategy": f"WITH {UNION} SELECT * FROM s0 UNION ALL SELECT * FROM s2",
    "hybrid_frames": f"WITH {UNION}, a AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1) SELECT * FROM a UNION ALL SELECT * FROM s2 WHERE media_id NOT IN (SELECT media_id FROM a GROUP BY media_id HAVING count(*) >= 20)",
    "dedupe_time": f"WITH RECURSIVE {FRAMES}, {_thin('d', 'fr', 'abs(n.ts_s - r.last) > 1800')} SELECT media_id, ts_s, image FROM d",
    "min_gap": f"WITH RECURSIVE {FRAMES}, {_thin('d', 'fr', 'n.ts_s - r.last >= 3600')} SELECT media_id, ts_s, image FROM d",
    "visual_steps": f"WITH RECURSIVE {STEPS} SELECT * FROM st",
    "source_priority": """WITH a AS (SELECT conv_id AS media_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS priority, trim(regexp_replace(CASE WHEN conv_id % 3 = 0 AND role <> 'assistant' THEN '  ' ELSE text END, '\\s+', ' ', 'g')) AS text FROM conversations),
      e AS (SELECT media_id, min(priority) AS priority FROM (SELECT media_id, priority FROM a GROUP BY media_id, priority HAVING priority <> 0 OR max(length(text)) > 0) GROUP BY media_id)
      SELECT media_id, turn, priority, CAST(length(text) AS BIGINT) AS n FROM a JOIN e USING (media_id, priority) WHERE text <> ''""",
    "merge_segments": f"""WITH RECURSIVE {SENTENCES}, m AS (SELECT media_id, seg_no, start_s, end_s, text, n, 1 AS g FROM sg WHERE seg_no = 1
      UNION ALL SELECT s.media_id, s.seg_no, CASE WHEN m.n < 8 OR m.end_s - m.start_s < 2.5 THEN m.start_s ELSE s.start_s END, s.end_s, CASE WHEN m.n < 8 OR m.end_s - m.start_s < 2.5 THEN m.text || ' ' || s.text ELSE s.text END,
        CASE WHEN m.n < 8 OR m.end_s - m.start_s < 2.5 THEN m.n + s.n ELSE s.n END, CASE WHEN m.n < 8 OR m.end_s - m.start_s < 2.5 THEN m.g ELSE m.g + 1 END FROM m JOIN sg s ON s.media_id = m.media_id AND s.seg_no = m.seg_no + 1)
      SELECT media_id, g AS seg_no, start_s, end_s, text FROM m QUALIFY row_number() OVER (PARTITION BY media_id, g ORDER BY m.seg_no DESC) = 1""",
    "assign_previous": f"WITH RECURSIVE {STEPS} SELECT * FROM pv UNION ALL SELECT * FROM late",
    "assign_nearest": f"WITH RECURSIVE {STEPS} SELECT * FROM nr UNION ALL SELECT * FROM late",
    "assign_last": f"WITH RECURSIVE {STEPS} SELECT * FROM pv UNION ALL SELECT media_id, last_step, CAST(seg_no AS BIGINT) FROM tl",
    "tail_steps": f"WITH RECURSIVE {STEPS} SELECT * FROM ex",
    "all_steps": f"WITH RECURSIVE {STEPS} SELECT media_id, step, ts_s, ts, image, is_extra, CAST(place AS INTEGER) AS place FROM al",
    "transcript_text": f"""WITH RECURSIVE {STEPS} SELECT m.media_id, coalesce(string_agg('[' || {_ts("start_s")} || '] ' || text, chr(10) ORDER BY seg_no) || chr(10), '(no transcript)' || chr(10)) AS transcript
      FROM (SELECT DISTINCT user_id AS media_id FROM events) m LEFT JOIN sp s USING (media_id) GROUP BY m.media_id""",
    "timeline_json": f"""WITH RECURSIVE {STEPS}, v AS (SELECT media_id, count(*) AS n, string_agg(step || ' ' || ts || ' ' || image, '|' ORDER BY step) AS x FROM st GROUP BY media_id),
      t AS (SELECT media_id, count(*) AS n, string_agg(seg_no || ' ' || {_ts("start_s")} || ' ' || {_ts("end_s")} || ' ' || text, '|' ORDER BY seg_no) AS x FROM sp GROUP BY media_id)
      SELECT m.media_id, 'm' || m.media_id || '.mp4' AS source, coalesce(v.n, 0) AS n_visual, coalesce(t.n, 0) AS n_transcript, coalesce(v.x, '') AS shown, coalesce(t.x, '') AS spoken FROM (SELECT DISTINCT user_id AS media_id FROM events) m LEFT JOIN v USING (media_id) LEFT JOIN t USING (media_id)""",
    "step_markdown": f"""WITH RECURSIVE {STEPS}, given AS (SELECT * FROM pv UNION ALL SELECT * FROM late),
      said AS (SELECT g.media_id, g.step, string_agg('   - `' || {_ts("start_s")} || ' → ' || {_ts("end_s")} || '` — ' || text, chr(10) ORDER BY sp.seg_no) AS x FROM given g JOIN sp ON sp.media_id = g.media_id AND sp.seg_no = g.seg_no GROUP BY g.media_id, g.step),
      own AS (SELECT * FROM al),
      body AS (SELECT o.media_id, string_agg(o.step || '. **' || ts || '**' || chr(10) || chr(10) || CASE WHEN image <> '' THEN '   ![](' || image || ')' ELSE '   _(Transcript-only step)_' END || chr(10) || coalesce(chr(10) || '   **Transcript:**' || chr(10) || x || chr(10), ''), chr(10) ORDER BY place) AS x FROM own o LEFT JOIN said s ON s.media_id = o.media_id AND s.step = o.step GROUP BY o.media_id)
      SELECT m.media_id, '# Recording' || chr(10) || chr(10) || '**Source:** `m' || m.media_id || '.mp4`' || chr(10) || chr(10) || '## Steps' || chr(10) || coalesce(chr(10) || b.x, '') || CASE WHEN m.media_id NOT IN (SELECT media_id FROM sp) THEN chr(10) || '_No transcript available._' || chr(10) ELSE '' END AS markdown
      FROM (SELECT DISTINCT user_id AS media_id FROM events) m LEFT JOIN body b USING (media_id)""",
    "format_times": f"WITH {EV} SELECT event_id, {_ts('ts_s - 5')} AS ts, {_ts('value * 10')} AS v, (ts_s + value) / 2.0 AS mid FROM ev",
    "clean_whitespace": f"SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM ({WRAPPED})",
    "clean_light": f"SELECT conv_id, turn, {_cleaned('text', 'light')} AS text FROM ({WRAPPED})",
    "clean_standard": f"SELECT conv_id, turn, {_cleaned('text', 'standard')} AS text FROM ({WRAPPED})",
    "redact_light": f"SELECT doc_id, {_replaced('text', 'light')} AS text FROM documents",
    "redact_standard": f"SELECT doc_id, {_replaced('text', 'standard')} AS text FROM documents",
    "redact_heavy": f"SELECT doc_id, {_replaced('text', 'heavy')} AS text FROM ({T2})",
    "redact_terms": f"SELECT doc_id, {_replaced('text', 'standard', True)} AS text FROM ({T2})",
    "redact_term_tables": f"WITH {_TERMS} SELECT doc_id, text, CAST(len(regexp_extract_all(text, '\\[(NAME|ORG|LOCATION)\\]')) AS BIGINT) AS n_hits FROM m",
    "redact_hit_places": f"""WITH {_t2_hits[0]}, hits AS ({_t2_hits[1]}) SELECT doc_id, pass_no, label, match, CAST(instr(text, match) - 1 AS INTEGER) AS orig_start, CAST(instr(text, match) - 1 + length(match) AS INTEGER) AS orig_end, match AS original FROM hits JOIN t0 USING (doc_id)""",
    "redact_hits": f"WITH {_t2_hits[0]} {_t2_hits[1]}",
    "redaction_counts": f"WITH {_docs_hits[0]} SELECT label, count(*) AS n FROM ({_docs_hits[1]}) GROUP BY label",
    "report": f"""WITH {_t2_light[0]}, hits AS ({_t2_light[1]}) SELECT doc_id, coalesce('[' || string_agg('{{"label":"' || label || '","match":"' || match || '","start":' || start || ',"end":' || "end" || '}}', ',' ORDER BY pass_no, start) || ']', '[]') AS report FROM t0 LEFT JOIN hits USING (doc_id) GROUP BY doc_id""",
    "clean_redact": f"SELECT doc_id, 't.' || doc_id || '.clean-standard__redact-heavy.txt' AS out_name, {_replaced(_cleaned('text', 'standard'), 'heavy')} AS text FROM ({T2})",
    "payload_valid": f"SELECT event_id, CASE WHEN json_valid({_payload}) THEN json_type({_payload}) = 'OBJECT' ELSE false END AS valid FROM events",
    "payload_faults": f"""SELECT CASE WHEN NOT json_valid({_payload}) THEN 'no json' WHEN json_type({_payload}) <> 'OBJECT' THEN 'no object' ELSE 'accepted' END AS reason, event_type, count(*) AS n FROM events GROUP BY ALL""",
    "payload_default": f"""WITH a AS (SELECT event_id, {_payload} AS raw, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw END AS p FROM events)
      SELECT event_id, CASE WHEN p IS NULL THEN '(no object)' WHEN NOT list_contains(json_keys(p), 'name') THEN 'friend' ELSE coalesce(json_extract_string(p, '$.name'), '(null)') END AS name, CAST(CASE WHEN p IS NULL THEN 0 ELSE len(json_keys(p)) END + CASE WHEN p IS NULL THEN 0 WHEN list_contains(json_keys(p), 'name') THEN 0 ELSE 1 END AS BIGINT) AS n FROM a""",
    "log_tail": "SELECT event_id, event_type AS agent, CAST(CASE WHEN value < 400 THEN 0 ELSE 1 END AS INTEGER) AS code FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
}
