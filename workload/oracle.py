"""Reference SQL (DuckDB dialect) for the registered queries, over the same tables.

The SQL follows the line-by-line definition of each step (split, transform, filter, join), where the Spark side uses
single patterns over the whole text, so that the two check each other.
"""

from __future__ import annotations

from postmill.operators.vocabulary import STOP_WORDS
from postmill.schema import HEADER_FIELDS, RECORD_FIELDS
from workload.queries import FROM_DAY, KEYWORD, SENDER, SENDERS, TO_DAY

# --- fixed values: character classes of the steps, spelled out here so that the two sides do not share them ---------
WORD = r"\p{L}\p{N}_"
ALNUM = r"\p{L}\p{N}"
INLINE_SPACE = r"\x{9}\x{b}\x{c}\x{d}\x{1c}\x{1d}\x{1e}\x{1f}\x{85}\p{Z}"
SPACE = r"\x{a}\x{9}\x{b}\x{c}\x{d}\x{1c}\x{1d}\x{1e}\x{1f}\x{85}\p{Z}"
# --- end of fixed values ----------------------------------------------------------------------------------------

NL = "chr(10)"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sub(text: str, pattern: str, new: str, flags: str = "g") -> str:
    new = new if new.startswith("chr(") or new.startswith("repeat(") else sql_text(new)
    return f"regexp_replace({text}, {sql_text(pattern)}, {new}, '{flags}')"


def strip(text: str) -> str:
    return sub(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def lstrip(text: str) -> str:
    return sub(text, rf"\A[{SPACE}]+", "")


def lines(text: str) -> str:
    return f"string_split({text}, {NL})"


def unlines(items: str) -> str:
    return f"array_to_string({items}, {NL})"


def replace_all(text: str, pairs) -> str:
    for old, new in pairs:
        text = f"replace({text}, {old}, {new})"
    return text


# --- mail-shaped views ------------------------------------------------------------------------------------------

MAIL = f"""dated AS (
  SELECT d.doc_id AS event_id, e.ts, coalesce(e.user_id, 0) AS user_id, coalesce(e.event_type, 'none') AS event_type
  FROM documents d LEFT JOIN events e ON d.doc_id = e.event_id),
mail AS (
  SELECT d.doc_id, '<' || d.doc_id || '.' || d.n_chars || '@' || d.source || '.example.org>' AS "Message-ID",
    CASE WHEN d.doc_id % 37 = 0 OR e.ts IS NULL THEN '' WHEN d.doc_id % 41 = 0 THEN 'not a date'
         ELSE strftime(e.ts, '%a, %-d %b %Y %H:%M:%S') || ' -0700 (PDT)' END AS "Date",
    'User ' || e.user_id || ' <u' || e.user_id || '@' || e.event_type || '.example.com>' AS "From",
    CASE WHEN d.doc_id % 13 = 0 THEN '' ELSE 'a' || (d.doc_id % 7) || '@x.example.com;  B < b' || (d.doc_id % 11)
         || '@y.example.com >,c@z.example.com' END AS "To",
    CASE WHEN d.doc_id % 25 = 0 THEN '' ELSE split_part(d.text, {NL}, 1) END AS "Subject",
    '1.0' AS "Mime-Version", 'text/plain; charset=us-ascii' AS "Content-Type", '7bit' AS "Content-Transfer-Encoding",
    'User ' || e.user_id AS "X-From", 'B' AS "X-To",
    CASE WHEN d.doc_id % 9 = 0 THEN 'd@w.example.com;E <e@v.example.com>' ELSE '' END AS "X-cc", '' AS "X-bcc",
    '\\' || d.source || '\\inbox' AS "X-Folder", d.source AS "X-Origin", d.lang || '.pst' AS "X-FileName",
    CASE WHEN d.doc_id % 20 = 0 THEN ''
      WHEN d.doc_id % 10 = 1 THEN '> ' || d.text
      WHEN d.doc_id % 10 = 2 THEN d.text || {NL} || '==========' || {NL} || '1. one' || {NL} || '* two'
      WHEN d.doc_id % 10 = 3 THEN 'a=20b =3D c=' || {NL} || 'd ' || d.text
      WHEN d.doc_id % 10 = 4 THEN 'x<br>y<STYLE a>z</STYLE>' || d.text
      WHEN d.doc_id % 10 = 5 THEN d.text || chr(13) || repeat({NL}, 5) || 'end.......'
      WHEN d.doc_id % 10 = 6 THEN '    ' || d.text || repeat(chr(9), 3) || 'z'
      WHEN d.doc_id % 10 = 7 THEN '__ >' || d.text || {NL} || '>' || {NL} || 'tail'
      WHEN d.doc_id % 10 = 8 THEN d.text || {NL} || 'a!!!!!!!!!' || {NL} || '-'
      WHEN d.doc_id % 10 = 9 THEN 'a' || chr(7) || 'b ' || d.text || ' itâ€™s'
      ELSE d.text END AS "Body",
    d.doc_id || '.' AS "SourceFile"
  FROM documents d LEFT JOIN dated e ON d.doc_id = e.event_id)"""

RAW = f"""raw AS (
  SELECT doc_id,
    '/' || "X-Origin" || '/' || doc_id || '/' || CASE doc_id % 6
      WHEN 0 THEN (doc_id % 50) || '' WHEN 1 THEN 'm' || (doc_id % 50) || '.txt' WHEN 2 THEN (doc_id % 50) || '.'
      WHEN 3 THEN 'm' || (doc_id % 50) || '.7' WHEN 4 THEN 'M.TXT' ELSE 'x' || doc_id || '.csv' END AS path,
    'Message-ID: ' || "Message-ID" || {NL} || 'Date: ' || "Date" || {NL} || 'From: ' || "From" || {NL}
      || 'To: ' || replace("To", ',', ',' || {NL} || chr(9)) || {NL} || 'Subject: ' || "Subject" || {NL}
      || CASE WHEN doc_id % 17 = 0 THEN 'Subject: Re: ' || "Subject" || {NL} ELSE '' END
      || CASE WHEN doc_id % 23 = 0 THEN 'a line that is no header' || {NL} || '  continued' || {NL} ELSE '' END
      || 'X-Folder: ' || "X-Folder" || CASE WHEN doc_id % 19 = 0 THEN {NL} ELSE {NL} || {NL} END || "Body" AS text
  FROM mail)"""

FILES = """files AS (SELECT '/' || source || '/' || doc_id || '.txt' AS path, text FROM documents)"""


def addresses(text: str) -> str:
    part = sub(strip("p"), rf"<[{SPACE}]*([^<>]+?)[{SPACE}]*>", r"\1")
    return f"array_to_string(list_transform(string_split_regex({text}, '[;,]'), lambda p: {part}), ', ')"


def european(text: str) -> str:
    bare = sub(strip(text), rf"[{SPACE}]+\(.*?\)\z", "", "")
    bare = sub(bare, rf"[{SPACE}]+[+-][0-9]{{4}}\z", "", "")
    found = rf"\A.*?([0-9]{{1,2}} [{WORD}]{{3}} [0-9]{{4}}) ([0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})"
    day = f"try_strptime(regexp_extract({bare}, {sql_text(found)}, 1), '%d %b %Y')"
    clock = f"regexp_extract({bare}, {sql_text(found)}, 2)"
    return f"CASE WHEN {day} IS NULL THEN {text} ELSE strftime({day}, '%d.%m.%Y') || ' ' || {clock} END"


def blank(text: str) -> str:
    return f"({strip(text)} = '')"


def route(subject_only: str = "skip") -> str:
    error = """WHEN "Body" = '' THEN 'processing_error' """ if subject_only == "skip" else ""
    return f"""CASE WHEN {blank('"Subject"')} AND {blank('"Body"')} THEN 'validation' {error}ELSE 'cleaned' END"""


FIXED = {"Date": european('"Date"')} | {n: addresses(f'"{n}"') for n in ("From", "To", "X-cc", "X-bcc")}


def fixed_columns(names, when: str | None = None) -> str:
    def one(n):
        if n not in FIXED:
            return f'"{n}"'
        value = FIXED[n] if when is None else f'CASE WHEN {when} THEN {FIXED[n]} ELSE "{n}" END'
        return f'{value} AS "{n}"'

    return ", ".join(one(n) for n in names)


# --- the body chain ---------------------------------------------------------------------------------------------

LIST_MARKER = rf"(?i)\A(?:\p{{Nd}}+\.|[a-z]\.|[a-z]\)|\(\p{{Nd}}+\)|\p{{Nd}}+\)|[ivx]+\.)[{SPACE}]+[{WORD}]"


def escapes(t):
    pairs = ((f"'=' || {NL}", "''"), ("'=20'", "' '"), ("'=09'", "chr(9)"), ("'=3D'", "'='"), ("'=22'", "'\"'"))
    return replace_all(t, (*pairs, ("'=27'", "''''")))


def spaces(t):
    return sub(sub(t, r"[ \t]{3,}", " "), rf"\n[{SPACE}]*\n[{SPACE}]*\n[{SPACE}]*\n+", f"repeat({NL}, 3)")


def controls(t):
    bare = sub(t, r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]", "")
    return f"replace(replace({bare}, chr(13) || {NL}, {NL}), chr(13), {NL})"


def line_start(line):
    head = lstrip(line)
    return (
        f"CASE WHEN {strip(line)} = '' THEN '' WHEN regexp_matches({head}, {sql_text(LIST_MARKER)}) THEN {head} "
        f"WHEN starts_with({head}, '_') THEN {sub(head, rf'\A_+[^{WORD}]*', '', '')} "
        f"ELSE {sub(head, rf'\A[^{WORD}]+', '', '')} END"
    )


def line_starts(t):
    return f"list_transform({lines(t)}, lambda l: {line_start('l')})"


def changed(t):
    return f"len(list_filter({lines(t)}, lambda l: l <> {line_start('l')}))"


def leading(t):
    return sub(unlines(line_starts(t)), r"\A\n+", "")


def tags(t):
    for name in ("br|BR", "p|P", "div|DIV"):
        t = sub(t, rf"<(?:{name})/?>", NL)
    for tag in ("html", "head", "body", "meta", "title", "style", "script"):
        t = sub(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
        t = sub(t, rf"(?i)<{tag}[^>]*/?>", "")
    return t


def mojibake(t):
    return replace_all(t, (("'�'", "''"), ("'â€™'", "''''"), ("'â€œ'", "'\"'"), ("'â€'", "'\"'")))


def symbol_lines(t):
    bare = strip("l")
    symbols = f"length({sub(bare, f'[{ALNUM}{SPACE}]', '')})"
    drop = (
        f"({bare} <> '' AND ((length({bare}) > 2 AND {symbols} / length({bare}) > 0.7) "
        rf"OR regexp_matches({bare}, '\A[=\-_~*#.>|+]{{2,}}\z')))"
    )
    t = unlines(f"list_filter({lines(t)}, lambda l: NOT {drop})")
    t = sub(t, rf"(?m)^[{SPACE}]*>+[{SPACE}]*", "")
    return sub(t, rf"(?m)^[{SPACE}]*[-*•·▪▫◦‣⁃][{SPACE}]*$", "")


def left_trim(t):
    return unlines(f"list_transform({lines(t)}, lambda l: {lstrip('l')})")


def punctuation(t):
    for pattern, new in ((r"\.{5,}", "..."), (r"-{6,}", "-----"), (r"={6,}", "=====")):
        t = sub(t, pattern, new)
    return t


CHAIN = (escapes, spaces, controls, leading, tags, mojibake, symbol_lines, left_trim, punctuation)
STEP_TEXT = (
    "'Cleaned quoted-printable encoding'",
    "'Cleaned excessive whitespace'",
    "'Removed control characters and line ending artifacts'",
    "'Removed ALL leading spaces and symbols - ' || lines_modified || "
    "' lines modified (preserved structured lists flush left)'",
    "'Removed safe HTML tags'",
    "'Fixed encoding artifacts'",
    "'Aggressive symbol and email artifact removal'",
    "'Final removal of ALL leading spaces from every line'",
    "'Cleaned excessive punctuation'",
)


def chain(source: str, column: str) -> str:
    """CTEs s0..s9 and ``done``: the source with ``t9`` (before the last strip), all intermediates and ``clean``."""
    parts = [f'c0 AS (SELECT *, "{column}" AS t0 FROM {source})']
    for i, step in enumerate(CHAIN):
        extra = f", {changed('t3')} AS lines_modified" if step is leading else ""
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT *, {step(f't{i}')} AS t{i + 1}{extra} FROM c{i})")
    parts.append(f"done AS (SELECT *, {strip('t9')} AS clean FROM c9)")
    return ",\n".join(parts)


STEPS_SQL = (
    "array_to_string(list_filter(["
    + ", ".join(
        f"CASE WHEN length(t{i}) <> length(t{i + 1}) THEN {text} END" for i, text in enumerate(STEP_TEXT)
    )
    + "], lambda s: s IS NOT NULL), ' | ')"
)


def percent(numerator: str, denominator: str) -> str:
    return f"CAST(format('{{:.2f}}', CAST({numerator} AS DOUBLE) / {denominator} * 100) AS DOUBLE)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BOARD = f"board AS (SELECT doc_id, {fixed_columns(RECORD_FIELDS)} FROM mail WHERE {route()} = 'cleaned')"
CLEAN_BOARD = (
    MAIL,
    f"passed AS (SELECT * FROM mail WHERE {route()} = 'cleaned')",
    chain("passed", "Body"),
    f"board AS (SELECT doc_id, {fixed_columns([n for n in RECORD_FIELDS if n != 'Body'])}, clean AS \"Body\" FROM done)",
)
TIMED = """timed AS (SELECT *, try_strptime("Date", '%d.%m.%Y %H:%M:%S') AS dt FROM board
  WHERE try_strptime("Date", '%d.%m.%Y %H:%M:%S') IS NOT NULL)"""
SHOWN = "strftime(dt, '%Y-%m-%d %H:%M:%S') AS \"DateTime\""
RANKED = """ranked AS (SELECT *, row_number() OVER (ORDER BY dt, "Message-ID") - 1 AS position FROM timed)"""
ON_BOARD = with_(MAIL, BOARD)
ON_TIME = with_(MAIL, BOARD, TIMED)
ON_RANK = with_(MAIL, BOARD, TIMED, RANKED)
LIST = '"Date", "From" AS "Sender", "To" AS "Recipient", "Subject", "Body"'
IN_RANGE = f"dt::date BETWEEN date '{FROM_DAY}' AND date '{TO_DAY}'"


def word_rows(source: str, column: str) -> str:
    runs = f"string_split({sub(f'lower({column})', f'[^{WORD}]+', ' ')}, ' ')"
    return f"""words AS (SELECT word FROM (SELECT unnest({runs}) AS word FROM {source}) w WHERE word <> ''),
counts AS (SELECT word, count(*) AS frequency FROM words GROUP BY word)"""


def merged_words(source: str, name: str) -> str:
    """CTE ``name(word, frequency)`` with plurals counted for their singular, and ``name_form(word, form)``."""
    return f"""{name}_form AS (SELECT u.word, coalesce(s.word, u.word) AS form, u.frequency
  FROM {source} u LEFT JOIN {source} s ON ends_with(u.word, 's') AND NOT ends_with(u.word, 'ss')
    AND s.word = left(u.word, length(u.word) - 1)),
{name} AS (SELECT form AS word, sum(frequency)::BIGINT AS frequency FROM {name}_form GROUP BY 1)"""


def likelihood(k: str, n: str, p: str) -> str:
    return f"(ln(greatest({p}, 1e-10)) * ({k}) + ln(greatest(1 - {p}, 1e-10)) * (({n}) - ({k})))"


STOPS = ", ".join(map(sql_text, STOP_WORDS))


def paired(source: str, column: str) -> str:
    runs = f"string_split({sub(f'lower({column})', f'[^{WORD}]+', ' ')}, ' ')"
    return rf"""toks AS (SELECT list_filter({runs}, lambda w: w <> '' AND NOT regexp_matches(w, '\A\p{{Nd}}+\z')) AS ws FROM {source}),
uni AS (SELECT word, count(*) AS frequency FROM (SELECT unnest(ws) AS word FROM toks) WHERE word NOT IN ({STOPS}) GROUP BY 1),
bi AS (SELECT a || ' ' || b AS word, count(*) AS frequency FROM (SELECT ws[i] AS a, ws[i + 1] AS b
  FROM (SELECT ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM toks))
  WHERE a NOT IN ({STOPS}) AND b NOT IN ({STOPS}) GROUP BY 1),
{merged_words('uni', 'm')}, {merged_words('bi', 'mb')},
facts AS (SELECT mb.word, mb.frequency, f1.form AS w1, f2.form AS w2, mb.frequency::DOUBLE AS c12, m1.frequency::DOUBLE AS c1,
    m2.frequency::DOUBLE AS c2, (SELECT sum(frequency) FROM uni)::DOUBLE AS n
  FROM mb JOIN m_form f1 ON f1.word = split_part(mb.word, ' ', 1) JOIN m_form f2 ON f2.word = split_part(mb.word, ' ', 2)
  JOIN m m1 ON m1.word = f1.form JOIN m m2 ON m2.word = f2.form),
together AS (SELECT * FROM facts WHERE n > c1 AND n > c2 AND -2 * ({likelihood('c12', 'c1', '(c2 / n)')}
  + {likelihood('c2 - c12', 'n - c1', '(c2 / n)')} - {likelihood('c12', 'c1', '(c12 / c1)')}
  - {likelihood('c2 - c12', 'n - c1', '((c2 - c12) / (n - c1))')}) > 30),
taken AS (SELECT word, sum(frequency) AS t FROM (SELECT w1 AS word, frequency FROM together
  UNION ALL SELECT w2, frequency FROM together) GROUP BY 1),
entries AS (SELECT m.word, (frequency - coalesce(t, 0))::BIGINT AS frequency FROM m LEFT JOIN taken USING (word)
  UNION ALL SELECT word, frequency FROM together)"""


TOP_20 = "SELECT word, frequency FROM counts ORDER BY frequency DESC, word LIMIT 20"


def daily(source: str, column: str) -> str:
    return f"""days AS (SELECT CAST({column} AS DATE) AS day, count(*) AS n FROM {source} GROUP BY 1),
span AS (SELECT CAST(unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day)) AS DATE) AS day
         FROM days)
SELECT strftime(span.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS emails FROM span LEFT JOIN days ON span.day = days.day"""


def by_hour(source: str, column: str) -> str:
    return f"""SELECT isodow({column}) - 1 AS day_order, dayname({column}) AS day_of_week, hour({column}) AS hour,
  count(*) AS emails FROM {source} GROUP BY ALL"""


def body_sql(expression: str) -> str:
    return with_(MAIL) + f'SELECT doc_id, {expression} AS "Body" FROM mail'


def audit_sql(key: str) -> str:
    return f"""SELECT {key}, {STEPS_SQL} AS cleaning_steps, length(t0) AS original_length,
  length(clean) AS final_length, CASE WHEN t0 = '' THEN 0.0 ELSE {percent('length(t0) - length(clean)', 'length(t0)')}
  END AS reduction_percent FROM done"""


# --- skip reports -----------------------------------------------------------------------------------------------

SKIPS = f"""numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS email_number, {route()} AS route FROM mail),
skips AS (SELECT email_number, "Message-ID" AS message_id, "SourceFile" AS source_file,
    CASE WHEN {blank('"Subject"')} THEN '[EMPTY]' ELSE {strip('"Subject"')} END AS subject,
    "From" AS "from", "Date" AS date,
    CASE route WHEN 'validation' THEN 'Validation failed: Both subject and body are empty'
      ELSE 'Processing error: not enough values to unpack (expected 5, got 0)' END AS skip_reason,
    CASE route WHEN 'validation' THEN 'Both subject and body are empty' ELSE '-' END AS validation_errors,
    NOT {blank('"Subject"')} AS has_subject, NOT {blank('"Body"')} AS has_body,
    length({strip('"Subject"')}) AS subject_length, length({strip('"Body"')}) AS body_length, route AS skip_stage
  FROM numbered WHERE route <> 'cleaned')"""

# --- files ------------------------------------------------------------------------------------------------------

PRINTS = "prints AS (SELECT path, md5(text) AS hash FROM files)"
GROUPS = "groups AS (SELECT hash, count(*) AS copies, min(path) AS first_path FROM prints GROUP BY hash)"
ON_PRINTS = with_(FILES, PRINTS, GROUPS)
NAME = "split_part(path, '/', -1)"
EXT = rf"regexp_extract({NAME}, '[^.].*?(\.[^.]*)\z', 1)"
BARE = rf"({EXT} = '' OR regexp_matches({EXT}, '\A\.[{SPACE}]*\p{{Nd}}+\z'))"
ELIGIBLE = f"(lower({EXT}) = '.txt' OR {BARE})"
NATURAL = (
    "list_transform(regexp_extract_all({0}, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') "
    "THEN chr(1) || lpad(p, 30, '0') ELSE p END)"
)

# --- parsing ----------------------------------------------------------------------------------------------------

BREAKS = r"\r\n|[\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def parsed(source: str, keep: str, name: str = NAME) -> str:
    """CTEs ending in ``parsed``. Lines are walked with list functions."""
    one = sub("text", BREAKS, NL)
    tidy = f"CASE WHEN ends_with(u, {NL}) THEN u[1:length(u) - 1] ELSE u END"
    header = rf"\A([{WORD}-]+):"
    is_cont = "(starts_with(l, ' ') OR starts_with(l, chr(9)))"
    fields = ", ".join(
        f"coalesce(list_filter(h, lambda x: starts_with(x, '{n}:'))[-1][{len(n) + 2}:], '') AS \"{n}\""
        for n in HEADER_FIELDS
    )
    value = strip(sub("l", header, "", ""))
    normal = (
        f"CASE WHEN {is_cont} THEN ' ' || {strip('l')} "
        f"ELSE regexp_extract(l, {sql_text(header)}, 1) || ':' || {value} END"
    )
    return f"""p1 AS (SELECT *, {one} AS u FROM {source}),
p2 AS (SELECT *, CASE WHEN u = '' THEN [] ELSE {lines(tidy)} END AS ls FROM p1),
p3 AS (SELECT *, coalesce(list_position(list_transform(ls, lambda l: {strip('l')} = ''), true), 0) AS b FROM p2),
p4 AS (SELECT *, list_filter(CASE WHEN b = 0 THEN ls ELSE ls[1:b - 1] END,
    lambda l: {is_cont} OR regexp_matches(l, {sql_text(header)})) AS hl FROM p3),
p5 AS (SELECT *, {unlines(f"list_transform(hl, lambda l: {normal})")} AS ht FROM p4),
p6 AS (SELECT *, {lines(f"replace(ht, {NL} || ' ', ' ')")} AS h FROM p5),
parsed AS (SELECT {keep}, {fields}, {strip(f"coalesce({unlines('ls[b + 1:]')}, '')")} AS "Body",
    {name} AS "SourceFile" FROM p6)"""


HEADERS = ", ".join(f'"{n}"' for n in HEADER_FIELDS)
ALL_FIELDS = ", ".join(f'"{n}"' for n in RECORD_FIELDS)


def surviving(collapse: bool) -> str:
    """CTE ``kept``: renamed, deduplicated and, optionally, collapsed files."""
    names = (
        f"named AS (SELECT path, text, CASE WHEN {BARE} THEN {NAME} || '.txt' ELSE {NAME} END AS name FROM raw "
        f"WHERE {ELIGIBLE}),\n"
        "unique_files AS (SELECT * FROM named QUALIFY NOT ends_with(name, '.txt') OR "
        "row_number() OVER (PARTITION BY ends_with(name, '.txt'), md5(text) ORDER BY path) = 1),\n"
    )
    last = " QUALIFY row_number() OVER (PARTITION BY name ORDER BY path DESC) = 1" if collapse else ""
    return names + f"kept AS (SELECT * FROM unique_files{last})"


REFINED = with_(MAIL, RAW, surviving(True), parsed("kept", "path", "name"))

ORACLE = {
    "top_senders": ON_BOARD
    + 'SELECT "From" AS sender, count(*) AS email_count FROM board GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10',
    "subject_word_freq": with_(MAIL, BOARD, word_rows("board", '"Subject"')) + TOP_20,
    "conversation_word_freq": with_(word_rows("conversations", "text")) + TOP_20,
    "document_words": with_(word_rows("documents", "text")) + "SELECT word, frequency FROM counts",
    "word_cloud_weights": with_(
        MAIL,
        BOARD,
        word_rows("board", '"Subject"'),
        rf"""used AS (SELECT * FROM counts WHERE NOT regexp_matches(word, '\A\p{{Nd}}+\z')
  AND word NOT IN ({', '.join(sql_text(w) for w in STOP_WORDS)}))""",
        merged_words("used", "merged"),
        "top AS (SELECT * FROM merged ORDER BY frequency DESC, word LIMIT 200)",
    )
    + "SELECT word, frequency, frequency / (SELECT max(frequency) FROM top) AS weight FROM top",
    "word_cloud_pairs": with_(paired("conversations", "text"))
    + "SELECT word, frequency FROM entries WHERE frequency > 0 ORDER BY frequency DESC, word LIMIT 200",
    "sender_domain": ON_BOARD + 'SELECT DISTINCT "From" AS "Sender" FROM board',
    "recipient_domain_placeholder": ON_BOARD
    + """SELECT DISTINCT coalesce(nullif("To", ''), '(unknown)') AS "To" FROM board""",
    "sender_filter": with_(*CLEAN_BOARD) + f"""SELECT {LIST} FROM board WHERE "From" = {sql_text(SENDER)}""",
    "sender_filter_count": ON_BOARD + f"""SELECT count(*) AS emails FROM board WHERE "From" = {sql_text(SENDER)}""",
    "mail_list_all": with_(*CLEAN_BOARD) + f"SELECT {LIST} FROM board",
    "full_view": with_(*CLEAN_BOARD) + f"SELECT {ALL_FIELDS} FROM board",
    "date_parse": ON_TIME + f'SELECT "Message-ID", {SHOWN} FROM timed',
    "time_bounds": ON_TIME
    + "SELECT strftime(min(dt), '%Y-%m-%d') AS min_date, strftime(max(dt), '%Y-%m-%d') AS max_date FROM timed",
    "range_sender_keyword_filter": ON_TIME
    + f"""SELECT "Message-ID", {SHOWN}, "From", "Subject" FROM timed WHERE {IN_RANGE}
  AND regexp_matches("From", '@(click|error)') AND regexp_matches("Subject", '(?i){KEYWORD}')""",
    "sender_list_filter": ON_TIME
    + f"""SELECT "Message-ID", {SHOWN}, "From" FROM timed WHERE {IN_RANGE}
  AND "From" IN ({', '.join(map(sql_text, SENDERS))})""",
    "subject_literal_search": ON_BOARD
    + """SELECT "Message-ID", "Subject" FROM board WHERE contains(lower("Subject"), 'er.')""",
    "timeline_points": ON_TIME + f'SELECT {SHOWN}, "From", "Subject" FROM timed',
    "overview": ON_TIME + f'SELECT {SHOWN}, "From", "Subject" FROM timed',
    "page_2": ON_RANK + f'SELECT {SHOWN}, "From", "Subject" FROM ranked WHERE position BETWEEN 50 AND 99',
    "page_after_first": ON_RANK + f'SELECT {SHOWN}, "From", "Subject" FROM ranked WHERE position BETWEEN 50 AND 99',
    "page_count": ON_TIME + "SELECT count(*) AS emails, (count(*) - 1) // 50 + 1 AS pages FROM timed",
    "detail_format": with_(*CLEAN_BOARD, TIMED)
    + """SELECT strftime(dt, '%Y-%m-%d %H:%M') || ' — ' || "Subject" AS title, "From" AS "from", "To" AS "to",
  coalesce(nullif("Body", ''), '_No content available_') AS body FROM timed""",
    "working_set_default": ON_RANK + f'SELECT {SHOWN}, "From", "Subject" FROM ranked WHERE position = 0',
    "working_set_topup": ON_RANK
    + f'SELECT position, "Message-ID", {SHOWN} FROM ranked WHERE position IN (0, 1, 5, 9)',
    "working_set_deep": ON_RANK + f'SELECT position, "Message-ID", {SHOWN} FROM ranked WHERE position IN (3, 60, 140)',
    "daily_volume": with_(MAIL, BOARD, TIMED, daily("timed", "dt").split("\nSELECT", 1)[0])
    + "SELECT" + daily("timed", "dt").split("\nSELECT", 1)[1],
    "daily_volume_gapfilled": "WITH " + daily("orders", "o_orderdate"),
    "daily_volume_events": "WITH " + daily("events", "ts"),
    "weekday_hour": by_hour("events", "ts"),
    "weekday_hour_mail": ON_TIME + by_hour("timed", "dt"),
    "weekday_hour_dense": with_(MAIL, BOARD, TIMED, f"seen AS ({by_hour('timed', 'dt')})")
    + """SELECT g.d AS day_order, dayname(date '2024-01-01' + CAST(g.d AS INTEGER)) AS day_of_week, g.h AS hour,
  coalesce(emails, 0) AS emails
FROM (SELECT d, unnest(generate_series(0, 23)) AS h FROM (SELECT unnest(generate_series(0, 6)) AS d)) g
LEFT JOIN seen ON seen.day_order = g.d AND seen.hour = g.h""",
    "clean_address_fields": with_(MAIL)
    + f"SELECT doc_id, {fixed_columns(('From', 'To', 'X-cc', 'X-bcc'))} FROM mail",
    "european_dates": with_(MAIL) + f"SELECT doc_id, {fixed_columns(('Date',))} FROM mail",
    "list_lines": with_(MAIL)
    + f"""SELECT doc_id, len(list_filter({lines('"Body"')}, lambda l: regexp_matches({strip('l')},
  {sql_text(LIST_MARKER)}))) AS list_lines FROM mail""",
    "changed_lines": with_(MAIL) + f"""SELECT doc_id, {changed('"Body"')} AS lines_modified FROM mail""",
    "clean_qp": body_sql(escapes('"Body"')),
    "clean_whitespace": body_sql(spaces('"Body"')),
    "clean_control": body_sql(controls('"Body"')),
    "clean_leading": body_sql(leading('"Body"')),
    "clean_html": body_sql(tags('"Body"')),
    "clean_mojibake": body_sql(mojibake('"Body"')),
    "clean_symbol_lines": body_sql(symbol_lines('"Body"')),
    "clean_final": body_sql(strip(punctuation(left_trim('"Body"')))),
    "clean_html_pages": f"SELECT page_id, {tags('html')} AS html FROM pages",
    "clean_symbol_pages": with_(f"bare AS (SELECT page_id, {tags('html')} AS t FROM pages)")
    + f"""SELECT page_id, {unlines(f"list_filter({lines('t')}, lambda l: NOT (({strip('l')} <> '') AND "
      f"((length({strip('l')}) > 2 AND length({sub(strip('l'), f'[{ALNUM}{SPACE}]', '')}) / length({strip('l')}) > 0.7) "
      rf"OR regexp_matches({strip('l')}, '\A[=\-_~*#.>|+]{{2,}}\z'))))")} AS html FROM bare""",
    "clean_body_full": with_(MAIL, chain("mail", "Body")) + "SELECT doc_id, clean AS cleaned_body FROM done",
    "clean_pages_full": with_(chain("pages", "html")) + "SELECT page_id, clean AS cleaned_body FROM done",
    "clean_conversations_full": with_(chain("conversations", "text"))
    + "SELECT conv_id, turn, clean AS cleaned_body FROM done",
    "clean_audit": with_(MAIL, chain("mail", "Body")) + audit_sql("doc_id"),
    "clean_audit_pages": with_(chain("pages", "html")) + audit_sql("page_id"),
    "validate_route": with_(MAIL)
    + f"""SELECT doc_id, {route()} AS route, CASE WHEN {route()} = 'validation'
  THEN 'Both subject and body are empty' ELSE '' END AS validation_errors FROM mail""",
    "validate_route_keep": with_(MAIL) + f"SELECT doc_id, {route('keep')} AS route FROM mail",
    "record_profile": with_(MAIL)
    + f"""SELECT doc_id, "Message-ID" AS message_id, "SourceFile" AS source_file, "From" AS sender, "Date" AS sent,
  CASE WHEN {blank('"Subject"')} THEN '[EMPTY]' ELSE {strip('"Subject"')} END AS shown_subject,
  NOT {blank('"Subject"')} AS has_subject, NOT {blank('"Body"')} AS has_body,
  length({strip('"Subject"')}) AS subject_length, length({strip('"Body"')}) AS body_length FROM mail""",
    "skipped_report": with_(MAIL, SKIPS) + "SELECT * FROM skips",
    "skip_details": with_(MAIL, SKIPS)
    + """SELECT upper(skip_stage) AS skip_stage, skip_reason, email_number, source_file, message_id, subject,
  has_subject::VARCHAR AS has_subject, has_body::VARCHAR AS has_body, subject_length::VARCHAR AS subject_length,
  body_length::VARCHAR AS body_length, validation_errors FROM skips""",
    "skips_by_reason": with_(MAIL, SKIPS)
    + "SELECT skip_stage, skip_reason, count(*) AS emails FROM skips GROUP BY 1, 2",
    "run_summary": with_(MAIL, f"routed AS (SELECT {route()} AS route FROM mail)")
    + f"""SELECT count(*) AS total, count(*) FILTER (route = 'cleaned') AS processed,
  count(*) FILTER (route <> 'cleaned') AS skipped, count(*) FILTER (route = 'validation') AS skipped_at_validation,
  count(*) FILTER (route = 'processing_error') AS skipped_on_error,
  {percent("count(*) FILTER (route = 'cleaned')", 'count(*)')} AS success_rate FROM routed""",
    "process_mail": with_(MAIL, f"routed AS (SELECT *, {route()} AS route FROM mail)", chain("routed", "Body"))
    + f"""SELECT doc_id, route, {fixed_columns(('Date', 'From', 'To', 'X-cc', 'X-bcc', 'Subject'), "route = 'cleaned'")},
  CASE WHEN route = 'cleaned' THEN clean ELSE "Body" END AS "Body",
  CASE WHEN route = 'cleaned' THEN {STEPS_SQL} ELSE '-' END AS cleaning_steps FROM done""",
    "content_fingerprint": ON_PRINTS + "SELECT path, hash FROM prints",
    "duplicate_sets": ON_PRINTS
    + "SELECT hash, copies, first_path, path FROM prints JOIN groups USING (hash) WHERE copies > 1",
    "dedup_keep_first": ON_PRINTS + "SELECT files.* FROM files JOIN groups ON files.path = groups.first_path",
    "dedup_removed": ON_PRINTS + "SELECT path, hash FROM prints JOIN groups USING (hash) WHERE path <> first_path",
    "dedup_report": ON_PRINTS
    + "SELECT 'Deleted duplicate file: ' || path AS value FROM prints JOIN groups USING (hash) WHERE path <> first_path",
    "dup_summary": ON_PRINTS
    + """SELECT count(*) AS duplicate_sets, sum(copies)::BIGINT AS files, sum(copies - 1)::BIGINT AS removed
FROM groups WHERE copies > 1""",
    "eligible_files": with_(MAIL, RAW) + f"SELECT path FROM raw WHERE {ELIGIBLE}",
    "normalized_names": with_(MAIL, RAW)
    + f"SELECT path, CASE WHEN {BARE} THEN {NAME} || '.txt' ELSE {NAME} END AS file_name FROM raw",
    "basename_collapse": with_(MAIL, RAW) + f"SELECT max(path) AS path FROM raw GROUP BY {NAME}",
    "natural_positions": with_(MAIL, RAW)
    + f"""SELECT path, {NAME} AS "SourceFile",
  row_number() OVER (ORDER BY {NATURAL.format(NAME)}, {NAME}, path) AS email_number FROM raw""",
    "corpus_counts": with_(MAIL, RAW, surviving(True))
    + f"""SELECT (SELECT count(*) FROM raw WHERE {ELIGIBLE}) AS files_found,
  (SELECT count(*) FROM kept) AS records_saved,
  (SELECT count(*) FROM ({with_(MAIL, RAW, surviving(False))} SELECT * FROM kept)) - (SELECT count(*) FROM kept) AS files_collapsed""",
    "lenient_decode": f"SELECT doc_id, text || {NL} || 'end' AS text FROM documents",
    "parse_headers": with_(MAIL, RAW, parsed("raw", "doc_id")) + f"SELECT doc_id, {HEADERS} FROM parsed",
    "parse_body": with_(MAIL, RAW, parsed("raw", "doc_id")) + 'SELECT doc_id, "Body" FROM parsed',
    "parse_record": with_(MAIL, RAW, parsed("raw", "doc_id")) + f"SELECT doc_id, {ALL_FIELDS} FROM parsed",
    "refined_records": REFINED + f"SELECT path, {ALL_FIELDS} FROM parsed",
    "refined_records_all_names": with_(MAIL, RAW, surviving(False), parsed("kept", "path", "name"))
    + f"SELECT path, {ALL_FIELDS} FROM parsed",
    "corpus_to_clean": with_(
        MAIL,
        RAW,
        surviving(True),
        parsed("kept", "path", "name"),
        f"""routed AS (SELECT *, {route()} AS route, row_number() OVER (ORDER BY {NATURAL.format('"SourceFile"')},
    "SourceFile", path) AS email_number FROM parsed)""",
        chain("routed", "Body"),
    )
    + f"""SELECT email_number, path, "SourceFile", route,
  {fixed_columns(('Date', 'From', 'To', 'Subject'), "route = 'cleaned'")},
  CASE WHEN route = 'cleaned' THEN clean ELSE "Body" END AS "Body" FROM done""",
    "flatten_props": "SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS props_k FROM events",
    "records_roundtrip": with_(MAIL) + f"SELECT {ALL_FIELDS} FROM mail",
}
TREE_FOLDER = "'/source=' || coalesce(source, '-') || '/lang=' || coalesce(lang, '-') || '/'"
ORACLE["duplicate_sets_split"] = ORACLE["duplicate_sets"]
ORACLE |= {
    "page_deep": ON_RANK + f'SELECT {SHOWN}, "From", "Subject" FROM ranked WHERE position BETWEEN 100 AND 149',
    "working_set_frame": ON_RANK
    + f'SELECT position, "Message-ID", {SHOWN} FROM ranked WHERE position IN (SELECT doc_id FROM documents)',
    "date_inferred": with_(MAIL, r"""timed AS (SELECT *, try_strptime(regexp_extract("Date", '^\w{3}, (\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) [+-]\d{4} [(]', 1),
  '%-d %b %Y %H:%M:%S') AS dt FROM mail)""") + f"SELECT doc_id, {SHOWN} FROM timed WHERE dt IS NOT NULL",
    "date_inferred_mixed": """WITH written AS (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE 'unknown' END AS t FROM orders
), forms AS (
  SELECT *, CASE WHEN try_strptime(t, '%d/%m/%Y') IS NOT NULL THEN '%d/%m/%Y' WHEN try_strptime(t, '%Y-%m-%d') IS NOT NULL THEN '%Y-%m-%d'
    WHEN try_strptime(t, '%m/%d/%Y') IS NOT NULL THEN '%m/%d/%Y' END AS form FROM written
), chosen AS (SELECT form FROM forms WHERE form IS NOT NULL ORDER BY o_orderkey LIMIT 1
), read AS (
  SELECT o_orderkey, CASE (SELECT form FROM chosen) WHEN '%d/%m/%Y' THEN try_strptime(t, '%d/%m/%Y') WHEN '%Y-%m-%d' THEN try_strptime(t, '%Y-%m-%d')
    ELSE try_strptime(t, '%m/%d/%Y') END AS dt FROM written
) SELECT o_orderkey, strftime(dt, '%Y-%m-%d %H:%M:%S') AS "DateTime" FROM read WHERE dt IS NOT NULL""",
    "subject_pattern_search": ON_BOARD + """SELECT "Message-ID", "Subject" || CASE WHEN contains("Subject", 'a') THEN 'm²' ELSE 'x' || chr(769) || '²' END AS "Subject"
FROM board WHERE contains("Subject", 'a')""",
    "committed_run": with_(*CLEAN_BOARD) + """SELECT email_number, "Message-ID", "Date", "From", "Subject", "Body"
FROM board JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS email_number FROM mail) USING (doc_id)""",
    "array_roundtrip": ORACLE["records_roundtrip"],
    "array_rejects": """SELECT CASE WHEN doc_id % 10 = 0 THEN 'reject' ELSE 'record' END AS kind,
  CASE WHEN doc_id % 10 = 0 THEN '{"Subject": ' || doc_id || ' oops}' ELSE text END AS value FROM documents""",
    "corpus_listing": f"""SELECT {TREE_FOLDER} AS folder, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes
FROM documents GROUP BY 1""",
    "corpus_ingest": f"""SELECT {TREE_FOLDER} AS folder, sum(length(t) - length(replace(t, chr(10), '')) + 1)::BIGINT AS lines,
  sum(length(t) + 1)::BIGINT AS characters
FROM (SELECT *, regexp_replace(replace(coalesce(text, ''), chr(65533), ''), '\r\n?', chr(10), 'g') AS t FROM documents) GROUP BY 1""",
    "tied_positions": """SELECT position, role, turn
FROM (SELECT role, turn, row_number() OVER (ORDER BY role NULLS FIRST, turn NULLS FIRST) - 1 AS position FROM conversations)
WHERE position IN (SELECT doc_id FROM documents)""",
    "tied_rows_once": "SELECT * FROM conversations",
    "tied_page": """SELECT o_orderstatus, o_orderpriority FROM orders
ORDER BY o_orderstatus NULLS FIRST, o_orderpriority NULLS FIRST LIMIT 40 OFFSET 240""",
    "collapsed_files": with_(MAIL, RAW)
    + f"""SELECT * FROM (SELECT path, {NAME} AS file_name, max(path) OVER (PARTITION BY {NAME}) AS kept_path FROM raw)
WHERE path <> kept_path""",
    "cleaned_table": f"SELECT * EXCLUDE (route) FROM ({ORACLE['corpus_to_clean']}) WHERE route = 'cleaned'",
    "skip_report_file": ORACLE["skipped_report"],
    "refined_records_bucketed": ORACLE["refined_records"],
    "removal_report_file": ORACLE["dedup_report"],
    "json_extra_fields": with_(MAIL) + f'SELECT {ALL_FIELDS}, "X-Origin" AS "Content" FROM mail',
    "json_rejects": """SELECT CASE WHEN doc_id % 10 = 0 THEN 'reject' ELSE 'record' END AS kind,
  CASE WHEN doc_id % 10 = 0 THEN '{"Subject": "' || doc_id ELSE text END AS value FROM documents""",
    "checked_records": ON_BOARD + 'SELECT "Message-ID" FROM board',
    "record_key_counts": with_(*CLEAN_BOARD)
    + " UNION ALL ".join(f"""SELECT '{n}' AS key, count(*) FILTER ("{n}" <> '') AS filled FROM board""" for n in RECORD_FIELDS),
}

#: Spark lengths, hours and counts of list elements are 32-bit.
INTEGERS = {
    "weekday_hour": ("day_order", "hour"),
    "weekday_hour_mail": ("day_order", "hour"),
    "weekday_hour_dense": ("day_order", "hour"),
    "list_lines": ("list_lines",),
    "changed_lines": ("lines_modified",),
    "clean_audit": ("original_length", "final_length"),
    "clean_audit_pages": ("original_length", "final_length"),
    "record_profile": ("subject_length", "body_length"),
    "skipped_report": ("subject_length", "body_length"),
    "skip_report_file": ("subject_length", "body_length"),
}
for _name, _columns in INTEGERS.items():
    _casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in _columns)
    ORACLE[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLE[_name]})"
