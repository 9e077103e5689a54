"""DuckDB SQL of the registered queries, written apart from the Spark code.

The patterns and word lists are written out here once more, so that a mistake in the
engine's shows; only the fixtures are shared.
"""

from __future__ import annotations

from inkstone import queries as Q

#: Fixed values, as the rules state them.
SPACE = r"[\x{09}-\x{0d} \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
CJK = r"[\x{3400}-\x{9fff}]"
NUMERAL = "[一二三四五六七八九十百千0-9０-９]+"
VOLUME = rf"^.{{0,16}}?卷(之{NUMERAL}|{NUMERAL}|[上中下])$"
VOLUME_END = rf"^.{{0,16}}?卷(之{NUMERAL}|{NUMERAL}|[上中下])竟$"
SCOPE = rf"^.{{0,20}}?卷(之{NUMERAL}|{NUMERAL}|[上中下])$"
EDITOR_NOTE = "^(經名|经名|底本出處|底本出处)[：:]"
VERSE = rf"^{CJK}{{4,10}}[，、。]?$"
CONTINUATION = "^[又右訖畢終终]$"
SAYS = rf"^{CJK}{{0,6}}曰[：:]?$"
SEQUENCE = f"^其{NUMERAL}$"
SECTIONS = "目錄 目录 附錄 附录 譯文 译文 告文 附方 序 跋 凡例 原序 後序 后序 自序 原跋".split()
DIRECTIVE = rf"^{CJK}{{2,14}}(如法|如式|如常式|如上法)$"
AUTHOR_LINE = rf"^{CJK}{{2,12}}(道士|真人|先生|居士|弟子|法師|天師){CJK}{{1,8}}(學|撰|註|注|集|編|纂|述|校|錄|疏|解)$"
STOPS = "[。？！；，、]"
STRONG_END = "[品篇章訣诀符圖图讚赞頌颂咒呪誥诰]$"
DEFINITION = rf"^{SPACE}*((?:[#＃]\d+)+)"
MAIN = r"^正[統统]道藏(洞[真玄神]部|太平部|太清部|太玄部|正一部)([\x{4e00}-\x{9fff}]+類)?-(.+)$"
SUPPLEMENT, SUPPLEMENT_LENIENT = "^續[续]道藏-(.+)$", "^[續续]道藏-(.+)$"
AUTHOR = r"^(.+?)-([南北朝宋元明清隋唐五代晉漢秦戰國周商夏])[-\x{4e00}-\x{9fff}]{1,8}$"
DIVISIONS = "洞真部 洞玄部 洞神部 太平部 太清部 太玄部 正一部 续道藏 其他".split()
TAGS = (
    ("科仪", "威儀|科儀|齋醮|道場|儀|忏|懺|法事"),
    ("咒诀", "咒|呪|訣|真言|神呪"),
    ("符箓", "符|籙|箓|灵符|靈符"),
    ("内丹", "内丹|內丹|金丹|修真|煉丹|悟真|參同|還丹|丹經|丹訣"),
    ("修炼", "坐忘|養性|修煉|修眞|清靜|黄庭|黃庭|导引|導引|胎息"),
    ("斋醮", "齋|醮|祭|祈禳|度亡"),
    ("注释", "注|疏|解|義|章句|集注|正義"),
    ("文集", "集|錄|語|論|說|要"),
    ("经典", "經$|真經|靈經|妙經"),
    ("续藏", "续"),
)
ASKING = "有什么|是什么|什么是|什么叫|为什么|什么样|什么|怎么样|怎么|如何|为何|是不是|有没有|有哪些|哪些|哪个|哪里|谁是|多少|请问|请解释|解释一下|介绍一下|讲讲|说说|告诉我|的意思|的含义|意思|含义|区别|关系|异同|是|的|和|与|或|了|吗|呢|啊|这|那|它|一下"
BREAKS = r"[，。？！、；：\s「」『』（）()？?!.,]+"
EVENTS = "page_view book_open chapter_open reading_progress reading_page_turn text_select bookmark_create note_create search ai_question ai_explanation music_play music_pause share recommendation_click illustration_generate illustration_view".split()


def _str(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(_str(v) if isinstance(v, str) else "NULL" if v is None else str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({names})"


def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '^{SPACE}+|{SPACE}+\z', '', 'g')"


def _preview(c: str) -> str:
    return _trim(rf"regexp_replace(substr({c}, 1, 300), '\r?\n', ' ', 'g')")


def _snippet(text: str, pos: str, n: str, before: int, after: int, squeeze: bool) -> str:
    start, end = f"greatest(0, {pos} - {before})", f"least(length({text}), {pos} + {n} + {after})"
    body = f"substr({text}, {start} + 1, {end} - {start})"
    if squeeze:
        body = f"trim(regexp_replace({body}, '{SPACE}+', ' ', 'g'))"
    return f"(CASE WHEN {start} > 0 THEN '…' ELSE '' END || {body} || CASE WHEN {end} < length({text}) THEN '…' ELSE '' END)"


E = rf"""e AS (SELECT doc_id AS ord, doc_id::VARCHAR AS id, split_part(text, chr(10), 1) AS title, lang AS category, source AS subcategory,
  CASE WHEN lang = 'en' THEN '正统道藏' ELSE '续道藏' END AS collection, CASE WHEN lang <> 'en' THEN source END AS author,
  len(regexp_split_to_array(text, '\r?\n'))::INT AS line_count, {_preview("text")} AS preview, text AS content FROM documents)"""

_DOCS = "SELECT doc_id::VARCHAR AS book_id, split_part(text, chr(10), 1) AS title, text AS source FROM documents"
_FIX = "SELECT book_id, title, source FROM " + _values([(b, t, "\n".join(x)) for b, t, x in Q.BOOKS], "book_id, title, source")


def _parse(source: str) -> str:
    """CTEs up to blocks and toc."""
    sections = ", ".join(map(_str, SECTIONS))
    m = lambda p: f"regexp_matches(text, '{p}')"
    taken = f"(NOT indented AND ((length(text) <= 24 AND {m(VOLUME_END)}) OR (length(text) <= 20 AND {m(VOLUME)})))"
    short = f"NOT indented AND length(text) BETWEEN 1 AND 16 AND NOT {m(STOPS)}"
    rules = [
        (m(EDITOR_NOTE), "editor-note", 0.9, "NULL"),
        (f"NOT indented AND length(text) <= 24 AND {m(VOLUME_END)}", "original-note", 0.9, "NULL"),
        (f"NOT indented AND length(text) <= 20 AND {m(VOLUME)}", "heading", 0.9, "2"),
        (f"NOT indented AND {m(CONTINUATION)}", "paragraph", 0.85, "NULL"),
        (f"NOT indented AND ({m(SAYS)} OR {m(SEQUENCE)})", "subheading", 0.85, "4"),
        (f"NOT indented AND text IN ({sections})", "subheading", 0.9, "3"),
        (f"NOT indented AND length(text) <= 16 AND {m(DIRECTIVE)}", "annotation", 0.8, "NULL"),
        (f"NOT indented AND length(text) <= 20 AND {m(AUTHOR_LINE)}", "original-note", 0.8, "NULL"),
        (f"{short} AND {m(STRONG_END)}", "subheading", 0.8, "3"),
        (short, "subheading", 0.65, "3"),
    ]
    case = lambda i, quote, other: "CASE " + " ".join(f"WHEN {r[0]} THEN {_str(r[i]) if quote else r[i]}" for r in rules) + f" ELSE {other} END"
    return rf"""books AS ({source}),
cut AS (SELECT book_id, title, unnest(regexp_split_to_array(coalesce(source, ''), '\r?\n')) AS line, unnest(range(len(regexp_split_to_array(coalesce(source, ''), '\r?\n')))) AS idx FROM books),
lines AS (SELECT book_id, title, idx::INT AS idx, {_trim("line")} AS text, regexp_matches(line, '^{SPACE}*\x{{3000}}') AS indented FROM cut),
ruled AS (SELECT *, {case(1, True, "'paragraph'")} AS rtype, ({case(2, False, "0.98")})::DOUBLE AS rconf, ({case(3, False, "NULL")})::INT AS rlevel,
  (NOT indented AND {m(VERSE)}) AS verse, {taken} AS taken FROM lines),
marked AS (SELECT *, coalesce(idx = min(CASE WHEN text <> '' THEN idx END) OVER (PARTITION BY book_id), false) AS is_title,
  sum(CASE WHEN verse THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY idx) AS island FROM ruled),
started AS (SELECT *, verse AND max(CASE WHEN verse AND NOT is_title AND NOT taken THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, island ORDER BY idx) = 1 AS s FROM marked),
runs AS (SELECT book_id, island, count(*) AS n, min(idx) AS lo, max(idx) AS hi, string_agg(text, chr(10) ORDER BY idx) AS joined FROM started WHERE s GROUP BY ALL),
kept AS (SELECT st.*, coalesce(s AND n >= 2, false) AS iv, lo, hi, joined FROM started st LEFT JOIN runs r ON st.book_id = r.book_id AND st.island = r.island),
seq AS (SELECT *, (row_number() OVER (PARTITION BY book_id ORDER BY idx) - 1)::INT AS block_seq FROM kept WHERE text <> '' AND (NOT iv OR idx = lo)),
blocks AS (SELECT book_id, block_seq, book_id || '-b' || block_seq AS block_id, CASE WHEN is_title THEN 'heading' WHEN iv THEN 'verse' ELSE rtype END AS type,
  CASE WHEN iv THEN joined ELSE text END AS content, CASE WHEN is_title THEN 1 WHEN NOT iv THEN rlevel END AS level, idx AS source_start, CASE WHEN iv THEN hi ELSE idx END AS source_end,
  (CASE WHEN is_title THEN CASE WHEN coalesce(title, '') <> '' AND (contains(text, title) OR contains(title, text)) THEN 0.95 ELSE 0.8 END WHEN iv THEN 0.5 ELSE rconf END)::DOUBLE AS confidence, 'rule-v3' AS parser FROM seq),
toc AS (SELECT book_id, block_seq, block_id, content AS title, coalesce(level, 3)::INT AS level FROM blocks WHERE type IN ('heading', 'subheading') AND confidence >= 0.6 AND coalesce(level, 3) <= 3)"""


DOC = _parse(_DOCS)
FIX = _parse(_FIX)
ALL = _parse(f"{_DOCS} UNION ALL {_FIX}")

_KEY = "source_start || ':' || substr(content, 1, 10)"
# DuckDB has no CRC-32: it is folded over the bits of the id.
_CRC = """crc AS (SELECT book_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(book_id) + 1), lambda i: ord(substr(book_id, i, 1))::BIGINT)),
  lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)::BIGINT[]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS h FROM books)"""
_OVERRIDES = f"""{_CRC}, overrides AS (SELECT b.book_id, {_KEY} AS key, CASE WHEN length(content) % 2 = 0 THEN 'paragraph' ELSE 'subheading' END AS type, (CASE WHEN length(content) % 2 = 1 THEN 3 END)::INT AS level
  FROM blocks b JOIN crc USING (book_id) WHERE block_seq = 1 AND xor(h, 4294967295::BIGINT) % 3 = 0)"""

_PAGES = """sized AS (SELECT book_id, block_seq, length(content)::BIGINT AS n, type IN ('heading', 'subheading') AS head FROM blocks),
walk AS (
  SELECT book_id, block_seq, 0 AS own, 0 AS start, n AS chars FROM sized WHERE block_seq = 0
  UNION ALL
  SELECT book_id, block_seq, own, CASE WHEN cut THEN block_seq + 1 ELSE own END, CASE WHEN cut THEN 0 ELSE chars END FROM (
    SELECT s.book_id, s.block_seq,
      CASE WHEN s.block_seq > w.start AND w.chars + s.n >= 1400 AND s.head THEN s.block_seq ELSE w.start END AS own,
      CASE WHEN s.block_seq > w.start AND w.chars + s.n >= 1400 AND s.head THEN s.n ELSE w.chars + s.n END AS chars,
      NOT (s.block_seq > w.start AND w.chars + s.n >= 1400 AND s.head) AND s.block_seq > w.start AND w.chars + s.n >= 2200 AS cut
    FROM walk w JOIN sized s ON s.book_id = w.book_id AND s.block_seq = w.block_seq + 1)),
paged AS (SELECT b.*, (dense_rank() OVER (PARTITION BY b.book_id ORDER BY own) - 1)::INT AS page_index FROM blocks b JOIN walk USING (book_id, block_seq)),
page_rows AS (SELECT k.book_id, coalesce(page_index, 0)::INT AS page_index, coalesce(min(block_seq), 0)::INT AS start_block, coalesce(max(block_seq), 0)::INT AS end_block, count(block_seq)::INT AS n_blocks, coalesce(sum(length(content)), 0)::BIGINT AS char_count
  FROM (SELECT DISTINCT book_id FROM books) k LEFT JOIN paged p ON p.book_id = k.book_id GROUP BY k.book_id, page_index)"""
_VOLUMES = """vols AS (SELECT b.book_id, b.block_seq, b.block_id,
  coalesce(last_value(CASE WHEN t.level = 2 THEN b.block_id END IGNORE NULLS) OVER w, first_value(CASE WHEN t.level = 1 THEN b.block_id END IGNORE NULLS) OVER w) AS volume_block_id,
  coalesce(last_value(CASE WHEN t.level = 2 THEN t.title END IGNORE NULLS) OVER w, first_value(CASE WHEN t.level = 1 THEN t.title END IGNORE NULLS) OVER w) AS volume_title
  FROM blocks b LEFT JOIN toc t ON b.book_id = t.book_id AND b.block_seq = t.block_seq AND t.level <= 2 WINDOW w AS (PARTITION BY b.book_id ORDER BY b.block_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

_NOTES = rf"""scoped AS (SELECT *, sum(CASE WHEN type = 'heading' AND level = 2 AND regexp_matches(content, '{SCOPE}') THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY block_seq)::INT AS scope FROM blocks),
defs AS (SELECT book_id, scope, num, arg_max(block_id, block_seq) AS def_block_id FROM (SELECT *, unnest(regexp_extract_all(regexp_extract(content, '{DEFINITION}', 0), '[#＃](\d+)', 1))::BIGINT AS num FROM scoped WHERE regexp_matches(content, '{DEFINITION}')) GROUP BY ALL),
refs AS (SELECT book_id, scope, block_id, unnest(range(len(f)))::INT AS ref_seq, unnest(f)::BIGINT AS num FROM (SELECT *, regexp_extract_all(content, '[#＃](\d+)', 1) AS f FROM scoped WHERE NOT regexp_matches(content, '{DEFINITION}')))"""

_EV = """ev AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'recommendation_click' WHEN 'view' THEN 'page_view' WHEN 'signup' THEN 'book_open' ELSE event_type END AS event,
  user_id::VARCHAR AS user_id, event_type, value, props AS extra_json, epoch_us(ts) // 1000 AS created_at, ts FROM events)"""

_TAG_CASES = []
for _tag, _pattern in TAGS:
    _rule = {
        "科仪": f"regexp_matches(title || subcategory, '{_pattern}')",
        "经典": f"regexp_matches(title, '{_pattern}') AND NOT regexp_matches(title, '注|疏|解')",
        "续藏": "contains(collection, '续') OR category = ''",
    }.get(_tag, f"regexp_matches(title, '{_pattern}')")
    _TAG_CASES.append(f"CASE WHEN {_rule} THEN '{_tag}' END")
TAGGED = f"list_filter([{', '.join(_TAG_CASES)}], lambda t: t IS NOT NULL)"

_FILES = _values([(f,) for f in Q.FILES], "filename")


def _named(supplement: str, files: str = _FILES) -> str:
    main = f"regexp_matches(filename, '{MAIN}')"
    extra = f"regexp_matches(filename, '{supplement}')"
    rest = f"CASE WHEN {main} THEN regexp_extract(filename, '{MAIN}', 3) WHEN {extra} THEN regexp_extract(filename, '{supplement}', 1) END"
    return f"""SELECT filename, CASE WHEN signed THEN regexp_extract(rest, '{AUTHOR}', 1) ELSE coalesce(rest, filename) END AS title,
  CASE WHEN main THEN '正统道藏' WHEN extra THEN '续道藏' ELSE '其他' END AS collection, CASE WHEN main THEN regexp_extract(filename, '{MAIN}', 1) WHEN extra THEN '续道藏' ELSE '其他' END AS category,
  CASE WHEN main THEN regexp_extract(filename, '{MAIN}', 2) ELSE '' END AS subcategory,
  CASE WHEN signed THEN regexp_extract(rest, '{AUTHOR}', 2) || '-' || substr(rest, length(regexp_extract(rest, '{AUTHOR}', 1)) + 2) END AS author
  FROM (SELECT *, coalesce(regexp_matches(rest, '{AUTHOR}'), false) AS signed FROM (SELECT filename, {main} AS main, {extra} AS extra, {rest} AS rest FROM {files}))"""


_KNOWN = ", ".join(map(_str, EVENTS))
C = rf"""{E}, c AS (SELECT * FROM e UNION ALL SELECT 1000000000 + substr(book_id, 2)::BIGINT, book_id, title, '太清部', '', '正统道藏', NULL, len(regexp_split_to_array(source, '\r?\n'))::INT, {_preview("source")}, source FROM ({_FIX}))"""


def _hits(terms: list[str], rows: str = "e") -> str:
    found = ", ".join(f"CASE WHEN instr(content, '{t}') > 0 THEN {{'pos': instr(content, '{t}'), 'i': {i}, 'term': '{t}'}} END" for i, t in enumerate(terms))
    in_title = " OR ".join(f"contains(title, '{t}')" for t in terms)
    return f"""{E if rows == "e" else C}, f AS (SELECT *, list_min(list_filter([{found}], lambda s: s IS NOT NULL)) AS m, ({in_title}) AS title_hit FROM {rows}),
hits AS (SELECT id, ord, title, m.term AS matched_term, (m.pos - 1)::INT AS pos, least(100, (length(content) - length(replace(content, m.term, ''))) // length(m.term))::INT AS match_count,
  {_snippet("content", "(m.pos - 1)", "length(m.term)", 40, 40, True)} AS snippet, title_hit FROM f WHERE m IS NOT NULL)"""


def _concepts(most: int = 3) -> str:
    """The concepts of q, as a list, from a table with a list p of its parts."""
    return f"list_slice(list_filter(p, lambda x, i: list_position(p, x) = i), 1, {most})"


_PARTS = rf"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(q, '《[^》]*》', '，', 'g'), '{ASKING}', '，', 'g'), '{BREAKS}'), lambda x: {_trim('x')}), lambda x: regexp_matches(x, '^{CJK}{{2,8}}$'))"
# Bodies as JSON values; their types are those of the values.
# Of repeated members the last counts, in the place of the first.
_LAST = "(SELECT arg_max(value, id) FROM json_each({0}) WHERE key = '{1}')"
_BODIES = rf"""b AS (SELECT batch_id, body::JSON AS j FROM {_values(Q.BODIES, "batch_id, body")} WHERE json_valid(body)),
l AS (SELECT batch_id, CASE json_type(j) WHEN 'ARRAY' THEN j WHEN 'OBJECT' THEN {_LAST.format("j", "events")} END AS l FROM b),
i AS (SELECT batch_id, unnest(json_extract(l, '$[*]')) AS e FROM l WHERE json_type(l) = 'ARRAY' AND json_array_length(l) BETWEEN 1 AND 50),
m AS (SELECT batch_id, {_LAST.format("e", "event")} AS event, {_LAST.format("e", "sessionId")} AS session, {_LAST.format("e", "bookId")} AS book, {_LAST.format("e", "extra")} AS x FROM i WHERE json_type(e) = 'OBJECT'),
w AS (SELECT *, CASE WHEN json_type(x) = 'OBJECT' THEN (SELECT '{{' || coalesce(string_agg('"' || key || '":' || v, ',' ORDER BY f), '') || '}}' FROM (SELECT key, min(id) AS f, arg_max(value, id)::VARCHAR AS v FROM json_each(x) GROUP BY key)) ELSE x::VARCHAR END AS t FROM m),
own AS (SELECT batch_id, event->>'$' AS event, CASE WHEN json_type(session) = 'VARCHAR' THEN session->>'$' END AS session_id, CASE WHEN json_type(book) = 'VARCHAR' THEN book->>'$' END AS book_id,
  CASE WHEN json_type(x) IN ('VARCHAR', 'NULL', 'BOOLEAN') AND t IN ('""', 'null', 'false') OR json_type(x) IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND t::DOUBLE = 0 THEN NULL WHEN json_type(x) = 'VARCHAR' THEN t ELSE regexp_replace(t, '(\d)\.0+([,}}\]]|$)', '\1\2', 'g') END AS extra
  FROM w WHERE json_type(event) = 'VARCHAR' AND event->>'$' IN ({_KNOWN}))"""
_SENT = f"""{_EV}, r AS (SELECT user_id || ':' || epoch_ms(date_trunc('minute', ts)) AS batch_id, *, count(*) OVER (PARTITION BY user_id, date_trunc('minute', ts)) <= 50 AND event IN ({_KNOWN}) AS good FROM ev)"""
_USERS = "u AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS id, replace(c_name, '#', '.') || '@Example.org' AS email FROM customer)"
_QUESTIONS = _values(list(enumerate(Q.QUESTIONS)), "id, q")
# What the searched terms in simplified characters are in the two traditional standards; other terms are the same in all.
FORMS = {"里面": ["里面", "裏面", "裡面"], "面条": ["面条", "麪條", "麵條"], "灵宝领教": ["灵宝领教", "靈寶領教"], "制造": ["制造", "製造"], "匣中杂记": ["匣中杂记", "匣中雜記"]}
_FORMS = f"coalesce(map_extract(MAP {{{', '.join(_str(k) + ': [' + ', '.join(map(_str, v)) + ']' for k, v in FORMS.items())}}}, term)[1], [term])"
_LOW = "confidence < 0.7"
_SHARE = lambda a, b: f"CASE WHEN {b} > 0 THEN printf('%.2f%%', {a} / {b} * 100) ELSE '-' END"

SQL = {
    "catalog_rollup": f"WITH {E} SELECT category AS name, count(*) AS count, array_to_string(list_sort(list_distinct(list(subcategory) FILTER (subcategory <> ''))), ',') AS subcategories FROM e GROUP BY category",
    "rollup_by_sound": f"WITH {E}, s AS (SELECT category, [{', '.join(map(_str, Q.SUBCATEGORIES))}][ord % {len(Q.SUBCATEGORIES)} + 1] AS sub FROM e) SELECT category AS name, n AS count, array_to_string(list_filter(['本文類', '表奏類', '方法類', '戒律類', '靈圖類', '譜錄類', '神符類', '威儀類', '玉訣類', '讚頌類', '眾術類'], lambda x: list_contains(subs, x)), ',') AS subcategories FROM (SELECT category, count(*) AS n, list(DISTINCT sub) AS subs FROM s GROUP BY category)",
    "catalog_of_pages": rf"""WITH f AS (SELECT page_id, html, [{', '.join(map(_str, Q.FILES))}][page_id % {len(Q.FILES)} + 1] AS n FROM pages),
h AS (SELECT CASE WHEN contains(n, '-') THEN split_part(n, '-', 1) || '-' || page_id || substr(n, strpos(n, '-') + 1) ELSE n || page_id END AS filename, html FROM f)
SELECT substr(sha256(filename || '.txt'), 1, 16) AS id, title, collection, category, subcategory, author, filename || '.txt' AS filename, strlen(html)::BIGINT AS size, len(regexp_split_to_array(html, '\r?\n'))::INT AS line_count FROM h JOIN ({_named(SUPPLEMENT, "(SELECT filename FROM h)")}) USING (filename)""",
    "jobs_of_orders": "WITH j AS (SELECT o_orderkey::VARCHAR AS id, o_custkey AS b, o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'map' ELSE 'scene' END AS type, ['done', 'pending', 'processing', 'failed'][o_orderkey % 4 + 1] AS status, o_orderkey % 3 > 0 AS has FROM orders WHERE o_orderkey % 7 > 0) SELECT 'k' || o_orderkey AS block_id, id AS job_id, CASE WHEN id IS NULL THEN 'insert' WHEN status = 'done' AND has OR status IN ('pending', 'processing') THEN 'reuse' ELSE 'reject' END AS action FROM orders LEFT JOIN j ON b = o_custkey AND k = o_orderkey AND type = 'scene'",
    "catalog_summary": f"WITH {E} SELECT 2 AS version, count(*) AS total_entries, count(DISTINCT category) AS categories FROM e",
    "catalog_filter_page": f"WITH {E} SELECT id, title FROM e WHERE category = 'en' AND subcategory = 'src1' ORDER BY ord LIMIT 30",
    "catalog_metadata_search": f"WITH {E} SELECT id, title, author FROM e WHERE contains(lower(title), 'erst') OR coalesce(contains(lower(author), 'erst'), false) OR contains(lower(preview), 'erst') OR contains(lower(title), 'src1') OR coalesce(contains(lower(author), 'src1'), false) OR contains(lower(preview), 'src1')",
    "catalog_facets": f"WITH {E} SELECT id, line_count, array_to_string(tags, ',') AS tags FROM (SELECT *, {TAGGED} AS tags FROM e) WHERE (contains(collection, '续') OR category = '') AND line_count < 200 AND list_has_any(tags, ['续藏', '科仪']) AND (contains(lower(title), 'en') OR coalesce(contains(lower(author), 'en'), false) OR contains(lower(preview), 'en')) ORDER BY line_count DESC, ord LIMIT 24 OFFSET 24",
    "tag_counts": f"WITH {E} SELECT tag, count(*) AS count FROM (SELECT unnest({TAGGED}) AS tag FROM e) GROUP BY tag",
    "tag_rules": f"SELECT filename, array_to_string({TAGGED}, ',') AS tags FROM ({_named(SUPPLEMENT)})",
    "parse_names": f"SELECT a.*, b.category AS lenient_category FROM ({_named(SUPPLEMENT)}) a JOIN ({_named(SUPPLEMENT_LENIENT)}) b USING (filename)",
    "size_labels": f"WITH {E} SELECT CASE WHEN line_count * 20 < 200 THEN '短篇' WHEN line_count * 20 < 2000 THEN '中篇' ELSE '长篇' END AS label, count(*) AS n FROM e GROUP BY 1",
    "entry_profile": rf"SELECT page_id, substr(sha256(url), 1, 16) AS id, strlen(html)::INT AS size, len(regexp_split_to_array(html, '\r?\n'))::INT AS line_count, {_preview('html')} AS preview FROM pages",
    "adjacent_entries": f"WITH {E} SELECT id, lag(id) OVER (ORDER BY ord) AS prev_id, lead(id) OVER (ORDER BY ord) AS next_id FROM e",
    "related_entries": f"WITH {E} SELECT id, related_id, rank FROM (SELECT a.id, b.id AS related_id, row_number() OVER (PARTITION BY a.id ORDER BY b.ord)::INT AS rank FROM e a JOIN e b ON a.category = b.category AND a.id <> b.id) WHERE rank <= 10",
    "title_picks": f"WITH {E}, w AS (SELECT place::INT AS place, wanted FROM (VALUES (0, 'Erst'), (1, 'Tion'), (2, 'zzzz'), (3, 'les'), (4, 'der ')) v(place, wanted)) SELECT place, wanted AS title, arg_min(id, ord) AS id FROM e JOIN w ON contains(title, wanted) GROUP BY ALL",
    "daily_pick": f"WITH {E} SELECT id, title FROM e WHERE ord = ({Q.NOW_MS} // 86400000) % (SELECT count(*) FROM e)",
    "sitemap": f"WITH {E} SELECT * FROM (VALUES ('{Q.BASE}', 'monthly', 1.0::DOUBLE), ('{Q.BASE}/catalog', 'monthly', 0.9::DOUBLE), ('{Q.BASE}/search', 'monthly', 0.8::DOUBLE), ('{Q.BASE}/about', 'yearly', 0.5::DOUBLE)) v(url, change_frequency, priority) UNION ALL SELECT '{Q.BASE}/text/' || id, 'yearly', 0.6::DOUBLE FROM e",
    "fulltext_search": f"WITH {_hits(['eron', 'thth'])} SELECT id, title, matched_term, match_count, snippet, title_hit FROM hits ORDER BY title_hit DESC, match_count DESC, ord LIMIT 20",
    "fulltext_hits": f"WITH {_hits(['ción', 'ung'])} SELECT id, matched_term, pos, match_count, snippet, title_hit FROM hits",
    "fulltext_after": f"WITH {_hits(['ción', 'ung'])} SELECT id, match_count, snippet, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY title_hit DESC, match_count DESC, ord LIMIT 5 OFFSET 10",
    "fulltext_total": f"WITH {_hits(['ción', 'ung'])} SELECT count(*) AS total FROM hits",
    "indexed_hits": f"WITH {_hits(['ción', 'ung', '天地玄宗'], 'c')} SELECT id, matched_term, pos, match_count, snippet, title_hit FROM hits",
    "indexed_short": f"WITH {_hits(['囊', 'ß', 'qu'], 'c')} SELECT id, matched_term, pos, match_count, snippet, title_hit FROM hits",
    "indexed_page": f"WITH {_hits(['eron', 'thth'], 'c')} SELECT id, title, matched_term, match_count, snippet, title_hit FROM hits ORDER BY title_hit DESC, match_count DESC, ord LIMIT 20",
    "indexed_metadata": f"WITH {C} SELECT id, title, author FROM c WHERE " + " OR ".join(f"coalesce(contains(lower({k}), '{t}'), false)" for t in ("erst", "src1", "三洞") for k in ("title", "author", "preview")),
    "in_book_search": f"WITH {DOC} SELECT block_id, {_snippet('content', '(instr(content, ' + chr(39) + 'on' + chr(39) + ') - 1)', '2', 12, 20, False)} AS snippet FROM blocks WHERE book_id = '7' AND contains(content, 'on') ORDER BY block_seq LIMIT 50",
    "highlight_pieces": f"WITH {E} SELECT id, len(string_split(title, 'on'))::INT AS pieces, array_to_string(string_split(title, 'on'), '[on]') AS marked FROM e",
    "visible_text": f"WITH {DOC} SELECT book_id, substr(string_agg(content, chr(10) ORDER BY block_seq), 1, 6000) AS text FROM blocks WHERE type IN ('paragraph', 'heading', 'subheading', 'annotation') GROUP BY book_id",
    "whole_text": f"WITH {DOC}, t AS (SELECT book_id, string_agg(content, chr(10) ORDER BY block_seq) AS text FROM blocks GROUP BY book_id) SELECT book_id, md5(text) AS md5, length(text)::INT AS chars FROM t",
    "concept_terms": rf"SELECT id::INT AS id, array_to_string(regexp_extract_all(q, '《([^》]{{1,20}})》', 1), ',') AS titles, array_to_string({_concepts()}, ',') AS concepts FROM (SELECT id, q, {_PARTS} AS p FROM {_QUESTIONS})",
    "parse_blocks": f"WITH {DOC} SELECT * FROM blocks",
    "parse_fixtures": f"WITH {FIX} SELECT * FROM blocks",
    "parse_toc": f"WITH {ALL} SELECT * FROM toc",
    "parse_stats": f"WITH {ALL}, s AS (SELECT book_id, count(*) AS n, count(*) FILTER ({_LOW}) AS low, arg_min(content, block_seq) AS f FROM blocks GROUP BY book_id) SELECT k.book_id, coalesce(nullif(k.title, ''), f, '') AS title, coalesce(n, 0) AS total_blocks, coalesce(low, 0) AS low_confidence_blocks, 'rule-v3' AS parser FROM books k LEFT JOIN s ON s.book_id = k.book_id",
    "overrides_applied": f"WITH {ALL}, {_OVERRIDES} SELECT b.book_id, block_id, CASE WHEN o.key IS NOT NULL THEN o.type ELSE b.type END AS type, CASE WHEN o.key IS NOT NULL THEN o.level ELSE b.level END AS level, CASE WHEN o.key IS NOT NULL THEN 1.0 ELSE confidence END::DOUBLE AS confidence, CASE WHEN o.key IS NOT NULL THEN 'human-review' ELSE parser END AS parser FROM blocks b LEFT JOIN overrides o ON b.book_id = o.book_id AND o.key = {_KEY}",
    "review_queue": f"WITH {ALL}, {_OVERRIDES}, near AS (SELECT *, {_KEY} AS key, coalesce(substr(lag(content) OVER w, 1, 30), '') AS prev_content, coalesce(substr(lead(content) OVER w, 1, 30), '') AS next_content FROM blocks WINDOW w AS (PARTITION BY book_id ORDER BY block_seq)) SELECT n.book_id, n.key, block_id, content, n.type AS rule_type, n.level AS rule_level, confidence, o.type AS override_type, o.level AS override_level, prev_content, next_content FROM near n LEFT JOIN overrides o ON n.book_id = o.book_id AND n.key = o.key WHERE {_LOW} OR o.key IS NOT NULL",
    "reviewed_books": f"WITH {ALL}, {_OVERRIDES}, {E} SELECT o.book_id, count(*) AS overrides, e.title FROM overrides o JOIN e ON e.id = o.book_id GROUP BY o.book_id, e.title",
    "illustration_injection": f"""WITH {ALL}, anchors AS (SELECT book_id, {_KEY} AS key, substr(content, 1, 5) AS caption FROM blocks WHERE block_seq = 2 AND length(content) % 4 = 0),
three AS (SELECT book_id, block_seq, 0 AS sub, block_id, type, content, confidence, parser FROM blocks
 UNION ALL SELECT b.book_id, block_seq, 1, block_id || '-illus', 'image', 'a.png', 1.0, 'ritual-illus' FROM blocks b JOIN anchors a ON a.book_id = b.book_id AND a.key = {_KEY}
 UNION ALL SELECT b.book_id, block_seq, 2, block_id || '-illus-cap', 'image-caption', caption, 1.0, 'ritual-illus' FROM blocks b JOIN anchors a ON a.book_id = b.book_id AND a.key = {_KEY})
SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY block_seq, sub) - 1)::INT AS block_seq, block_id, type, content, confidence, parser FROM three""",
    "page_of_block": f"WITH RECURSIVE {ALL}, {_PAGES} SELECT book_id, block_id, page_index FROM paged",
    "paginate_books": f"WITH RECURSIVE {ALL}, {_PAGES} SELECT * FROM page_rows",
    "volume_carry": f"WITH {ALL}, {_VOLUMES} SELECT book_id, block_id, volume_block_id, volume_title FROM vols",
    "toc_parent": f"WITH {ALL} SELECT c.book_id, c.block_id, (SELECT arg_max(p.block_id, p.block_seq) FROM toc p WHERE p.book_id = c.book_id AND p.block_seq < c.block_seq AND p.level < c.level) AS parent_id FROM toc c",
    "toc_pages": f"WITH RECURSIVE {ALL}, {_PAGES} SELECT t.book_id, t.block_id, t.level, coalesce(page_index, 0)::INT AS page_index, (coalesce(page_index, 0) + 1)::INT AS page_id FROM toc t LEFT JOIN paged p ON p.book_id = t.book_id AND p.block_id = t.block_id",
    "active_toc": f"WITH RECURSIVE {ALL}, {_PAGES} SELECT r.book_id, r.page_index, coalesce((SELECT arg_max(t.block_id, t.block_seq) FROM toc t WHERE t.book_id = r.book_id AND t.block_seq <= r.start_block), (SELECT arg_min(t.block_id, t.block_seq) FROM toc t WHERE t.book_id = r.book_id)) AS active_block_id FROM page_rows r",
    "page_fetch": f"""WITH RECURSIVE {DOC}, {_PAGES}, {_VOLUMES}, asks AS (SELECT 'r' || book_id AS request_id, book_id, (length(book_id) * 2 - 3)::INT AS page_num, CASE WHEN book_id LIKE '%5' THEN 'x' END AS volume FROM books),
totals AS (SELECT book_id, count(*) AS total_pages FROM page_rows GROUP BY book_id),
j AS (SELECT a.*, total_pages, start_block, end_block, char_count, CASE WHEN page_num < 1 THEN 400 WHEN end_block IS NULL THEN 404 WHEN volume IS NOT NULL AND volume IS DISTINCT FROM volume_block_id THEN 409 ELSE 200 END::INT AS status
 FROM asks a LEFT JOIN totals USING (book_id) LEFT JOIN page_rows p ON p.book_id = a.book_id AND p.page_index + 1 = a.page_num LEFT JOIN vols v ON v.book_id = a.book_id AND v.block_seq = p.start_block)
SELECT request_id, book_id, page_num, status, CASE WHEN status = 200 AND page_num > 1 THEN page_num - 1 END::INT AS prev_page, CASE WHEN status = 200 AND page_num < total_pages THEN page_num + 1 END::INT AS next_page,
 CASE WHEN status = 200 THEN start_block END AS start_block, CASE WHEN status = 200 THEN end_block END AS end_block, CASE WHEN status = 200 THEN char_count END AS char_count, CASE WHEN status = 200 THEN total_pages END AS total_pages FROM j""",
    "scroll_pages": "SELECT event_id, (CASE WHEN event_id % 9 <= 1 THEN 0 ELSE least(event_id % 9 - 1, greatest(0, floor(value / 100 * (event_id % 9)))) END)::INT AS page_index FROM events",
    "footnote_refs": f"WITH {ALL}, {_NOTES} SELECT * FROM refs",
    "footnote_definitions": f"WITH {ALL}, {_NOTES} SELECT * FROM defs",
    "footnote_resolve": f"WITH {ALL}, {_NOTES} SELECT r.book_id, r.scope, block_id, r.num, def_block_id FROM refs r LEFT JOIN defs d ON r.book_id = d.book_id AND r.scope = d.scope AND r.num = d.num",
    "footnote_orphans": f"WITH {ALL}, {_NOTES} SELECT book_id, block_id, num FROM refs r WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE r.book_id = d.book_id AND r.scope = d.scope AND r.num = d.num)",
    "quality_by_type": f"WITH {ALL} SELECT type, count(*) AS blocks, count(*) FILTER ({_LOW}) AS low_confidence FROM blocks GROUP BY type",
    "low_conf_shapes": f"WITH {ALL} SELECT shape, n FROM (SELECT type || ': ' || substr(content, 1, 12) AS shape, count(*) AS n, min({{'b': book_id, 's': block_seq}}) AS f FROM blocks WHERE {_LOW} GROUP BY 1 ORDER BY n DESC, f LIMIT 40)",
    "worst_documents": f"WITH {ALL}, s AS (SELECT book_id, count(*) FILTER ({_LOW}) AS low_confidence, count(*) AS total FROM blocks GROUP BY book_id ORDER BY low_confidence / total DESC, book_id LIMIT 20) SELECT *, {_SHARE('low_confidence', 'total')} AS share FROM s",
    "quality_totals": f"WITH {ALL}, s AS (SELECT count(DISTINCT book_id) AS books, count(*) AS total_blocks, count(*) FILTER ({_LOW}) AS low_confidence FROM blocks) SELECT *, {_SHARE('low_confidence', 'total_blocks')} AS share FROM s",
    "event_batches": f"WITH {_BODIES} SELECT batch_id, event, session_id, book_id, extra AS extra_json, 120 AS platform_chars FROM own",
    "event_batch_status": f"WITH {_SENT}, {_BODIES}, s AS (SELECT batch_id, count(*) FILTER (good) AS stored FROM r GROUP BY batch_id UNION ALL SELECT batch_id, (SELECT count(*) FROM own WHERE own.batch_id = v.batch_id) FROM {_values([(i, 0) for i, _ in Q.BODIES], 'batch_id, x')}) SELECT batch_id, stored, CASE WHEN stored > 0 THEN 200 ELSE 400 END AS status FROM s",
    "event_append": f"WITH {_SENT}, {_BODIES} SELECT batch_id, event, 's' || user_id AS session_id, NULL AS book_id, user_id, event_id AS client_ts FROM r WHERE good UNION ALL SELECT batch_id, event, session_id, book_id, 'u1', CASE WHEN json_valid(extra) THEN json_extract_string(extra, '$.ts')::BIGINT END FROM own",
    "event_stream": f"WITH {_SENT} SELECT event, count(*) AS n, 2 * count(*) AS received FROM r WHERE good GROUP BY event",
    "events_valid": f"WITH {_EV} SELECT event_id, event, user_id FROM ev WHERE event IN ({_KNOWN})",
    "event_daily_counts": f"WITH {_EV} SELECT strftime(ts, '%Y-%m-%d') AS day, event, count(*) AS n FROM ev GROUP BY ALL",
    "quota_decisions": f"WITH {_EV}, r AS (SELECT event_id AS call_id, user_id AS key, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id)::INT AS n FROM ev) SELECT call_id, key, day, least(n - 1, 5)::INT AS used, n <= 5 AS allowed, greatest(0, 5 - n)::INT AS remaining FROM r",
    "quota_counts": f"WITH {_EV} SELECT user_id AS key, strftime(ts, '%Y-%m-%d') AS day, count(*) AS count FROM ev GROUP BY ALL",
    "quota_keys": f"""WITH {_EV}, k AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN event WHEN event_id % 3 = 1 THEN 'anonymous' END AS session, CASE WHEN event_id % 5 = 0 THEN user_id END AS u FROM ev),
h AS (SELECT *, abs(list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(extra_json) + 1), lambda i: ord(substr(extra_json, i, 1))::BIGINT)), lambda a, b: ((a * 31 + b + 2147483648) & 4294967295) - 2147483648)) AS n FROM k),
d AS (SELECT *, list_transform(range(1, 8), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((n // (36::BIGINT ** (7 - i))::BIGINT) % 36)::INT + 1, 1)) AS digits FROM h)
SELECT event_id, CASE WHEN u IS NOT NULL THEN 'user:' || u WHEN coalesce(session, '') NOT IN ('', 'anonymous') THEN 'anon:' || session ELSE 'ip:' || coalesce(nullif(ltrim(array_to_string(digits, ''), '0'), ''), '0') END AS key FROM d""",
    "progress_latest": f"WITH {_EV} SELECT user_id, event AS book_id, extra_json AS data_json, created_at AS updated_at FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, event ORDER BY created_at DESC, extra_json DESC) = 1",
    "reading_duration_running": f"WITH {_EV} SELECT event_id AS visit_id, (sum(floor(coalesce(value, 0) * 10)::BIGINT) OVER (PARTITION BY user_id, event ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS total_ms FROM ev",
    "resume_links": f"""WITH {_EV}, p AS (SELECT event_id AS n, user_id AS book_id, CASE WHEN event_id % 3 > 0 THEN event_id % 7 - 1 END AS page_index, CASE WHEN event_id % 2 = 0 THEN 'b%2F' || event_id END AS vol, CASE WHEN event_id % 4 > 0 THEN 'blk' END AS blk, CASE WHEN event_id % 5 > 0 THEN event_id % 11 END AS total FROM ev)
SELECT n AS event_id, '/text/' || book_id || CASE WHEN page_index >= 0 THEN '?page=' || (page_index + 1) || coalesce('&volume=' || vol, '') WHEN blk IS NOT NULL THEN '#' || blk ELSE '' END AS href,
 CASE WHEN page_index IS NOT NULL AND coalesce(total, 0) <> 0 THEN '第 ' || (page_index + 1) || '/' || total || ' 页' ELSE floor(n % 1000 / 1000 * 100 + 0.5)::BIGINT || '%' END AS label FROM p""",
    "job_patch_state": f"""WITH {_EV}, p AS (SELECT user_id AS job_id, created_at AS seen, event_id AS patch_id, CASE WHEN event_id % 2 = 0 THEN event END AS status, CASE WHEN event_id % 7 = 0 THEN 'failed' END AS error, CASE WHEN event_id % 3 = 0 THEN '/i/' || event_id END AS image_url FROM ev)
SELECT job_id, arg_max(status, {{'a': seen, 'p': patch_id}}) FILTER (status IS NOT NULL) AS status, arg_max(error, {{'a': seen, 'p': patch_id}}) FILTER (error IS NOT NULL) AS error, arg_max(image_url, {{'a': seen, 'p': patch_id}}) FILTER (image_url IS NOT NULL) AS image_url, max(seen) AS updated_at FROM p GROUP BY job_id""",
    "recent_items": f"WITH {_EV} SELECT user_id, event_id AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id)::INT AS rank FROM ev QUALIFY rank <= 3",
    "chat_last10": "WITH c AS (SELECT conv_id, turn::BIGINT AS turn, role, text FROM conversations), m AS (SELECT * FROM c UNION ALL SELECT conv_id + 1000000000, turn + 100 * k, role, text FROM c, range(3) t(k) WHERE conv_id % 3 = 0) SELECT conv_id, turn, role, text FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10",
    "ring_neighbours": "SELECT n_regionkey AS list_id, n_name AS track_id, coalesce(lag(n_name) OVER w, last_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev_id, coalesce(lead(n_name) OVER w, first_value(n_name) OVER w) AS next_id FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)",
    "toc_ancestors": f"WITH RECURSIVE {ALL}, up AS (SELECT c.book_id, c.block_id, (SELECT arg_max(p.block_id, p.block_seq) FROM toc p WHERE p.book_id = c.book_id AND p.block_seq < c.block_seq AND p.level < c.level) AS parent FROM toc c), walk AS (SELECT book_id, block_id, parent AS next, block_id AS path FROM up UNION ALL SELECT w.book_id, w.block_id, u.parent, u.block_id || '>' || path FROM walk w JOIN up u ON u.book_id = w.book_id AND u.block_id = w.next) SELECT book_id, block_id, path FROM walk WHERE next IS NULL",
    "toc_answers": f"WITH RECURSIVE {ALL}, {_PAGES} SELECT book_id, count(*) AS total_pages, (SELECT count(*) FROM toc t WHERE t.book_id = r.book_id) AS items FROM page_rows r GROUP BY book_id",
    "page_fetch_at": f"WITH RECURSIVE {DOC}, {_PAGES}, asks AS (SELECT book_id, (length(book_id) - 2)::INT AS page_index FROM books) SELECT a.book_id AS request_id, a.book_id, a.page_index, CASE WHEN a.page_index < 0 THEN 400 WHEN end_block IS NULL THEN 404 ELSE 200 END::INT AS status, start_block, end_block, total_pages FROM asks a JOIN (SELECT book_id, count(*) AS total_pages FROM page_rows GROUP BY book_id) USING (book_id) LEFT JOIN page_rows r ON r.book_id = a.book_id AND r.page_index = a.page_index",
    "footnote_counts": f"WITH {ALL}, {_NOTES} SELECT r.book_id, count(def_block_id) AS resolved, count(*) - count(def_block_id) AS orphans FROM refs r LEFT JOIN defs d ON r.book_id = d.book_id AND r.scope = d.scope AND r.num = d.num GROUP BY r.book_id",
    "progress_of_user": f"WITH {_EV} SELECT event AS book_id, extra_json AS data_json, created_at AS updated_at FROM ev WHERE user_id = '7' QUALIFY row_number() OVER (PARTITION BY event ORDER BY created_at DESC, extra_json DESC) = 1",
    "quota_used": "SELECT user_id::VARCHAR AS key, count(*) FILTER (strftime(ts, '%Y-%m-%d') = '2024-01-15') AS used FROM events GROUP BY user_id",
    "job_reuse": "WITH j AS (SELECT * FROM (VALUES ('j1', 'k', 'done', '/u'), ('j2', 'l', 'failed', NULL), ('j3', 'm', 'pending', NULL), ('j4', 'o', 'done', '')) v(job_id, block_id, status, url)) SELECT a.block_id, job_id, CASE WHEN job_id IS NULL THEN 'insert' WHEN status = 'done' AND coalesce(url, '') <> '' OR status IN ('pending', 'processing') THEN 'reuse' ELSE 'reject' END AS action FROM (SELECT unnest(['k', 'l', 'm', 'n', 'o']) AS block_id) a LEFT JOIN j USING (block_id)",
    "unique_insert": "WITH fresh AS (SELECT * FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT * REPLACE (lower(n_name) AS n_name) FROM nation WHERE n_nationkey >= 5) SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, min(n_name), arg_min(n_regionkey, n_name) FROM fresh WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 10) GROUP BY n_nationkey",
    "duplicate_keys": "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) > 1",
    "catalog_sorted": f"WITH {E} SELECT id, line_count FROM e ORDER BY line_count, ord LIMIT 30 OFFSET 60",
    "content_lookup": f"WITH {E} SELECT id, CASE WHEN category <> 'en' THEN length(content) ELSE 0 END::INT AS chars FROM e",
    "corpus_scan": f"WITH {E} SELECT id, title, length(content)::INT AS chars FROM e WHERE category <> 'en'",
    "catalog_build": f"SELECT substr(sha256(filename || '.txt'), 1, 16) AS id, title, collection, category, subcategory, author, filename || '.txt' AS filename, (9 + 3 * i)::BIGINT AS size, 3::INT AS line_count, trim('甲 乙 ' || repeat('丙', i)) AS preview FROM (SELECT *, list_position([{', '.join(map(_str, Q.FILES))}], filename) - 1 AS i FROM ({_named(SUPPLEMENT)}))",
    "catalog_positions": "SELECT p_partkey AS id, row_number() OVER (ORDER BY lower(regexp_replace(p_name, '[^A-Za-z ]', '', 'g')), p_partkey) - 1 AS ord FROM part",
    "title_order": "SELECT * FROM (VALUES ('安', 1, 6), ('八', 2, 4), ('丁', 3, 3), ('一', 4, 1), ('乙', 5, 2), ('中', 6, 5), ('alpha', 7, 7), ('Zeta', 8, 8)) v(title, by_sound, by_strokes)",
    "catalog_order": f"WITH k AS (SELECT coalesce([{', '.join(map(_str, DIVISIONS))}][doc_id % 11 + 1], 'x' || doc_id % 11) AS name, count(*) AS count FROM documents GROUP BY 1) SELECT (row_number() OVER (ORDER BY coalesce(list_position([{', '.join(map(_str, DIVISIONS))}], name), 0), name) - 1)::INT AS place, name, count FROM k",
    "catalog_results": f"WITH {E} SELECT id, (SELECT count(*) FROM e WHERE category = 'en') AS total FROM e WHERE category = 'en' ORDER BY ord LIMIT 30 OFFSET 30",
    "catalog_default": f"WITH {E} SELECT id FROM e WHERE category = (SELECT min(category) FROM e) UNION ALL SELECT id FROM e WHERE id = '7'",
    "catalog_files": f"WITH {E} SELECT count(*) AS entries, sum(line_count)::BIGINT AS lines, max(ord) AS last, 2::BIGINT AS version, count(*) AS total_entries, '2026-01-01T00:00:00Z' AS build_time, count(DISTINCT category) AS names, count(*)::BIGINT AS counted FROM e",
    "catalog_file": "SELECT n_name AS id, n_name || ' 經' AS title, 3::INT AS line_count, n_nationkey::BIGINT AS size, row_number() OVER (ORDER BY n_nationkey) - 1 AS ord FROM nation",
    "content_store": f"WITH {E} SELECT id, length(content)::INT AS chars FROM e UNION ALL SELECT 'one 7', length(content)::INT FROM e WHERE id = '7'",
    "overrides_file": f"WITH {ALL}, {_OVERRIDES} SELECT book_id, key, CASE type WHEN 'subheading' THEN 'verse' ELSE type END AS type, CASE type WHEN 'subheading' THEN 2 END::INT AS level, CASE type WHEN 'subheading' THEN 2 ELSE 1 END::BIGINT AS reviewed_at FROM overrides WHERE type <> 'subheading' OR coalesce(try_cast(book_id AS BIGINT) % 2, 1) <> 0 UNION ALL SELECT 'a', '1:x', 'quote', 1, 2",
    "report_lines": f"""WITH {ALL}, {C}, t AS (SELECT count(DISTINCT book_id) AS books, count(*) AS n, count(*) FILTER ({_LOW}) AS low FROM blocks),
k AS (SELECT type, count(*) AS n, count(*) FILTER ({_LOW}) AS low FROM blocks GROUP BY type),
s AS (SELECT type || ': ' || substr(content, 1, 12) AS shape, count(*) AS n, min({{'b': book_id, 's': block_seq}}) AS f FROM blocks WHERE {_LOW} GROUP BY 1 ORDER BY n DESC, f LIMIT 40),
w AS (SELECT book_id, count(*) FILTER ({_LOW}) AS low, count(*) AS n FROM blocks GROUP BY book_id ORDER BY low / n DESC, book_id LIMIT 20),
m AS (SELECT '# Parsing quality

- Built: 2026-01-01
- Parser: rule-v3
- Books parsed: ' || format('{{:,}}', books) || ' / ' || (SELECT format('{{:,}}', count(*)) FROM c) || '
- Blocks: ' || format('{{:,}}', n) || '
- Low confidence: ' || format('{{:,}}', low) || ' (' || {_SHARE('low', 'n')} || ')

## Types

| Type | Blocks | Low confidence |
|---|---|---|
'
 || (SELECT string_agg('| ' || type || ' | ' || format('{{:,}}', n) || ' | ' || format('{{:,}}', low) || ' |', '
' ORDER BY n DESC, type) FROM k)
 || '

## Common shapes of low confidence

| Shape | Times |
|---|---|
' || (SELECT string_agg('| ' || replace(shape, '|', '\\|') || ' | ' || format('{{:,}}', n) || ' |', '
' ORDER BY n DESC, f) FROM s)
 || '

## Books with the largest share

| Book | Low / all | Share |
|---|---|---|
' || (SELECT string_agg('| ' || title || ' | ' || format('{{:,}}', low) || '/' || format('{{:,}}', n) || ' | ' || {_SHARE('low', 'n')} || ' |', '
' ORDER BY low / n DESC, book_id) FROM w JOIN c ON c.id = w.book_id) || '
' AS x FROM t)
SELECT unnest(range(len(string_split(x, '
'))))::INT AS line, unnest(string_split(x, '
')) AS text FROM m""",
    "user_lookups": f"WITH {_USERS} SELECT id, email, 'email' AS by FROM u WHERE lower(email) = 'customer.000000007@example.org' UNION ALL SELECT id, email, 'id' FROM u WHERE id = '9'",
    "registration": rf"WITH {_USERS}, a AS (SELECT id, k, CASE WHEN k % 5 = 0 THEN ' ' || upper(email) WHEN k % 7 = 0 THEN replace(email, '@', ' ') WHEN k % 11 > 0 THEN email END AS mail FROM u) SELECT id, CASE WHEN NOT coalesce(regexp_matches(trim(mail), '^[^\s@]+@[^\s@]+\.[^\s@]+$'), false) OR k % 9 < 6 THEN 400 WHEN k % 2 = 1 THEN 409 ELSE 200 END::INT AS status FROM a",
    "progress_lookup": f"WITH {_EV} SELECT user_id, event AS book_id, extra_json AS data_json, created_at AS updated_at FROM ev WHERE user_id = '7' AND event = 'page_view' ORDER BY created_at DESC, extra_json DESC LIMIT 1",
    "scroll_share": "SELECT event_id, round(CASE WHEN event_id % 9 > 1 THEN event_id % 7 / (event_id % 9 - 1) ELSE 0 END, 9)::DOUBLE AS share FROM events",
    "job_lookups": "WITH j AS (SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS book_id, 'b' || o_orderkey % 3 AS block_id, CASE WHEN o_orderkey % 2 = 0 THEN 'scene' ELSE 'map' END AS type FROM orders) SELECT *, 'id' AS by FROM j WHERE id = '7' UNION ALL SELECT *, 'block' FROM j WHERE book_id = '7' AND block_id = 'b1' AND type = 'scene'",
    "question_references": rf"""WITH {C}, asked AS (SELECT question_id::BIGINT AS question_id, q, book_id, book_title, block_id, {_PARTS} AS p, regexp_extract_all(q, '《([^》]{{1,20}})》', 1)[1:3] AS t FROM {_values(Q.ASKED, "question_id, q, book_id, book_title, block_id")}),
named AS (SELECT question_id, unnest(t) AS term, unnest(range(len(t))) AS place FROM asked),
known AS (SELECT question_id, place, term, arg_min({{'id': id, 'title': title, 'preview': preview}}, ord) AS book FROM (SELECT *, unnest({_FORMS}) AS v FROM named) JOIN c ON contains(lower(title), lower(v)) OR coalesce(contains(lower(author), lower(v)), false) OR contains(lower(preview), lower(v)) GROUP BY ALL),
terms AS (SELECT question_id, 0 AS step, place, CASE WHEN length(term) >= 2 THEN term ELSE book.title END AS term FROM known UNION ALL SELECT question_id, unnest(range(1, len(x) + 1)), 0, unnest(x) FROM (SELECT question_id, {_concepts()} AS x FROM asked)),
spelt AS (SELECT *, unnest(f) AS v, unnest(range(len(f))) AS i FROM (SELECT *, {_FORMS} AS f FROM terms)),
met AS (SELECT question_id, step, place, term, id, min({{'pos': instr(content, v), 'i': i, 'v': v}}) AS m FROM spelt JOIN c ON contains(content, v) GROUP BY ALL),
found AS (SELECT question_id, step, place, id, title, term, row_number() OVER (PARTITION BY question_id, step, place ORDER BY (SELECT bool_or(contains(c.title, s.v)) FROM spelt s WHERE s.term = met.term) DESC, least(100, (length(content) - length(replace(content, m.v, ''))) // length(m.v)) DESC, ord) AS rank,
  {_snippet("content", "(m.pos - 1)", "length(m.v)", 40, 40, True)} AS snippet FROM met JOIN c USING (id)),
every AS (SELECT k.question_id, 0 AS step, k.place, book.id AS id, book.title AS title, CASE WHEN f.id = book.id THEN snippet ELSE substr(book.preview, 1, 150) END AS quote, 'title' AS source FROM known k LEFT JOIN found f ON f.question_id = k.question_id AND f.step = 0 AND f.place = k.place AND rank = 1
  UNION ALL SELECT question_id, step, rank, id, title, snippet, term FROM found WHERE step > 0 AND rank <= 2),
once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY question_id, id ORDER BY step, place) = 1),
kept AS (SELECT * FROM once o WHERE (SELECT count(*) FROM once x WHERE x.question_id = o.question_id AND x.step < o.step) < 5),
cited AS (SELECT question_id, step, place, id AS book_id, title AS book_title, NULL AS block_id, substr(quote, 1, 100) AS quote, source FROM kept
  UNION ALL SELECT question_id, 9, 0, book_id, coalesce(book_title, ''), block_id, NULL, 'reading' FROM asked a WHERE coalesce(book_id, '') <> '' AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.question_id = a.question_id AND k.id = a.book_id))
SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY step, place))::INT AS place, book_id, book_title, block_id, quote, source FROM cited""",
    "query_as_typed": f"WITH {_hits(['灵宝领教', '靈寶領教'], 'c')} SELECT id, matched_term, match_count, 'full' AS mode FROM (SELECT * FROM hits ORDER BY title_hit DESC, match_count DESC, ord LIMIT 20) UNION ALL SELECT id, NULL, NULL, 'full mode' FROM c WHERE contains(content, '三洞') UNION ALL SELECT id, NULL, NULL, 'meta mode' FROM c WHERE contains(title, '三洞') OR contains(preview, '三洞')",
    "chapter": f"WITH {ALL} SELECT block_id, 'toc' AS part FROM toc WHERE book_id = '7' UNION ALL SELECT block_id, 'block' FROM blocks WHERE book_id = '7' AND block_seq < 200",
    "tool_calls": "SELECT * FROM (VALUES (0, 'found'), (1, 'entry lacks entry_id'), (2, 'unknown tool: nope'), (3, 'hidden needs the permission review'), (4, 'found'), (5, 'empty')) v(call, outcome)",
    "footnote_bodies": rf"WITH {ALL}, d AS (SELECT *, regexp_extract(content, '{DEFINITION}', 0) AS head FROM blocks WHERE regexp_matches(content, '{DEFINITION}')) SELECT book_id, block_id, array_to_string(list_transform(regexp_extract_all(head, '[#＃](\d+)', 1), lambda x: x::BIGINT::VARCHAR), ',') AS nums, regexp_replace(substr(content, length(head) + 1), '^{SPACE}+', '') AS body FROM d",
    "footnote_segments": rf"""WITH {ALL}, d AS (SELECT book_id, block_id, regexp_split_to_array(content, '[#＃]\d+') AS t, regexp_extract_all(content, '[#＃]\d+') AS r FROM blocks WHERE regexp_matches(content, '[#＃]\d') AND NOT regexp_matches(content, '{DEFINITION}')),
s AS (SELECT book_id, block_id, list_filter(flatten(list_transform(range(1, len(t) + 1), lambda i: [{{'kind': 'text', 'value': t[i]}}, {{'kind': 'ref', 'value': coalesce(r[i], '')}}])), lambda x: x.value <> '') AS s FROM d)
SELECT book_id, block_id, place, x.kind AS kind, x.value AS value, CASE WHEN x.kind = 'ref' THEN substr(x.value, 2)::BIGINT END AS num FROM (SELECT book_id, block_id, unnest(range(len(s)))::INT AS place, unnest(s) AS x FROM s)""",
    "footnote_display": f"WITH {ALL} SELECT type, CASE WHEN regexp_matches(content, '{DEFINITION}') THEN 'footnote' ELSE type END AS display, count(*) AS n FROM blocks GROUP BY ALL",
    "url_parts": "SELECT p_partkey, url_encode(p_name) AS url FROM part",
    "store_progress": f"WITH {_EV} SELECT user_id, event AS book_id, extra_json AS data_json, created_at AS updated_at FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, event ORDER BY created_at DESC, extra_json DESC) = 1",
    "store_quota": f"WITH {_EV} SELECT user_id AS quota_key, strftime(ts, '%Y-%m-%d') AS day, count(*) AS count FROM ev GROUP BY ALL",
    "store_users": f"WITH {_USERS} SELECT id, lower(email) AS email, CASE WHEN k % 3 > 0 THEN c_name END AS name, 1::BIGINT AS created_at FROM u JOIN customer ON c_custkey = k",
    "store_jobs": f"""WITH {_EV}, j AS (SELECT user_id AS id, 'k' || user_id AS block_id, min(created_at) AS made FROM ev GROUP BY user_id),
p AS (SELECT user_id AS job_id, created_at AS seen, event_id AS patch_id, CASE WHEN event_id % 2 = 0 THEN event END AS status, CASE WHEN event_id % 7 = 0 THEN 'failed' END AS error, CASE WHEN event_id % 3 = 0 THEN '/i/' || event_id END AS image_url FROM ev),
s AS (SELECT job_id AS id, arg_max(status, {{'a': seen, 'p': patch_id}}) FILTER (status IS NOT NULL) AS status, arg_max(error, {{'a': seen, 'p': patch_id}}) FILTER (error IS NOT NULL) AS error, arg_max(image_url, {{'a': seen, 'p': patch_id}}) FILTER (image_url IS NOT NULL) AS image_url, max(seen) AS updated_at FROM p GROUP BY job_id)
SELECT id, block_id, '源' || id AS source_text, coalesce(status, 'pending') AS status, error, image_url, made AS created_at, updated_at FROM j JOIN s USING (id)""",
    "store_events": f"WITH {_SENT}, {_BODIES} SELECT event, count(*) AS n FROM (SELECT event FROM r WHERE good UNION ALL SELECT event FROM own) GROUP BY event",
}

#: Pages written before give the same answers.
SQL["served_fetch"] = SQL["page_fetch"]
