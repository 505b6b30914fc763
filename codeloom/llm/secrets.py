"""Credentials embedded in source code: found by what a dictionary can't explain, and blanked in place.

One pass over the texts counts words and lifts out literals that stand where credentials stand: assigned to a telling
name, passed beside one, in a URL, a header, a comment or a key block.  The word counts of the whole corpus become a
dictionary; each literal is segmented into dictionary words by Viterbi, and what stays unexplained is its residual.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.tables import written

#: Words the dictionary keeps (the most frequent ones).
DICTIONARY_WORDS = 50_000
#: Least unexplained characters, and their least share of a literal's length, that make it a credential in each place:
#: what a telling name is given, the second half of a pair in a comment, and anything else that is given or passed on.
RESIDUAL = {"named": (3, 0.15), "pair": (4, 0.2), "bare": (10, 0.6)}
#: Shorter literals can't be credentials where nothing tells.
BARE_LEAST = 10
#: What a character costs that no word explains, in bits.
UNKNOWN_BITS = 7.0

# Words that tell of a credential, alone or before "key", and words that turn such a name into another thing.
_TELLING = frozenset(
    "auth authorization credential credentials dsn login pass passcode passphrase passwd password pin pw pwd secret token".split())
_KEY_KINDS = frozenset("access api auth client encryption master private secret service signing".split())
_JOINED = frozenset("accesskey accesstoken apikey apitoken clientsecret privatekey secretkey signingkey dbpass dbpassword".split())
_OTHER_THING = frozenset(
    "class count counter digest env error expiry factory field file hash header hint id ids label length limit manager message"
    " mode name param path pattern policy prompt provider public regex salt size strategy template text timeout title ttl type"
    " uri url user username var".split())
_LOOKUP = re.compile(r"(?i)(?:getenv|environ(?:\.get)?|getProperty|readPassword|getpass|process\.env|config\.get|vault\w*\.\w+|resolve|lookup)\s*[\[(]\s*$")
_PLACEHOLDER = re.compile(
    r"(?i)\$\{|\$\(|\{\{|\}\}|^<[^<>]*>$|^%\w+%$|^%[sd]$|^\{\w*\}$|^\[.*\]$|change[-_ ]?me|your[-_ ]|example|insert[-_ ]|replace[-_ ]?me"
    r"|^(?:x+|\*+|\.+|-+|todo|tbd|dummy|sample|test|none|null|redacted|secret|password)$|process\.env|PUBLIC KEY|^\$\w+$|^@\w+@$")
_DIGEST = re.compile(r"^(?:(?:md5|sha\d*|sha-\d+)[:=-]?.*|\$2[aby]\$.*|\$argon2.*|\$[156]\$.*)$", re.I)
_FIXED = re.compile(r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
                    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$")
_HINT = re.compile(
    r"(?i)pass|pwd|secret|token|key|auth|credential|login|dsn|bearer|basic\s|sig=|://[^\s/@'\"]+@|eyJ"
    r"|(?-i:(?<![a-z])(?:pin|pw)(?![a-z])|P(?:in|w)(?![a-z])|P(?:IN|W)(?![A-Za-z]))|(?<!\S)-(?:u|-user)[ =]")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:.*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)?", re.S)
_URL = re.compile(r"(?<![\w+.-])[A-Za-z][\w+.:-]{0,40}://[^\s/:@\"']*:([^\s/@\"']+)@|[?&](?:api_?key|token|access_token|secret|password|sig)=([^&\s\"'#]+)"
                  r"|(?<!\S)-(?:u|-user)[ =][\"']?[\w.@\\-]+:([^\s\"']{6,})")
_SIGNED = re.compile(r"[\"'`](eyJ[A-Za-z0-9+/=_-]*\.[A-Za-z0-9+/=._-]{20,})[\"'`]")
_SCHEME = re.compile(r"\b(?:Bearer|Basic|Token)\s+([A-Za-z0-9+/=._~-]{8,})")
#: Literals, which hold no comment, and comments.
_COMMENT = re.compile(
    r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`\n]*`|((?<!:)//[^\n]*|/\*.*?(?:\*/|$)|<!--.*?(?:-->|$)|#[^\n]*|--[^\n]*|^\s*\*.*?(?:\*/|$))")
_REMARK = re.compile(
    r"(?i)\b(?:login|password|passwd|pwd|credentials?|secret|token|api key)\b[^:=\n/\"']{0,15}[:=]\s*([^\s/\"']+)(?:[ \t]*/[ \t]*(\S+))?")
_LOGIN = re.compile(r"(?i)login|credential")
_SETTING = re.compile(r"^\s*([\w.\-]+)\s*[:=]\s*([^\s\"'|>{\[][^\n]*?)\s*$")
_PIECE = re.compile(r"\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)'|`([^`\n]*)`|([A-Za-z_$][\w$]*)|(;)|([(\[{])|([)\]}])|(,)")
_BLOCK = re.compile(r"\s*(?:->[^:\n]*)?(?:\{|:[ \t\r]*\n|=>|throws\b)")
_ASSIGNED = re.compile(r"\s*(?:=(?![=>])|:(?!:))")
#: A literal of one long run, and a setting without quotes.
_LONG = re.compile(r"[\"'`][^\s\"'`]{%d,}[\"'`]|^[ \t]*[\w.\-]+[ \t]*[:=][ \t]*[^\s\"'|>{\[(]\S{%d,}[ \t\r]*$" % (BARE_LEAST, BARE_LEAST - 1), re.M)
#: A pair in a comment: a label, an account, and what may be its password.
_PAIR = re.compile(r"([^\W\d][\w \t-]*?)[ \t]*[:=][ \t]*[\w.@\\-]{2,}[ \t]*/[ \t]+([^\s/]{6,})")
#: A long run with a digit by itself, and what such a run is called in a comment.
_RUN = re.compile(r"(?:([\w-]+)[ \t]*[:=]?[ \t]+|(?<=[:=]))(?=\S*\d)([A-Za-z0-9+/=_\-]{16,})(?=[\s,.;)]|$)")
_RUNS = re.compile(r"(?<=[ \t:=])[A-Za-z+/=_\-]*\d[A-Za-z0-9+/=_\-]{14,}(?=[\s,.;)]|$)")
_PAIRED = re.compile(r"[:=][ \t]*[\w.@\\-]{2,}[ \t]*/[ \t]+[^\s/]{6,}")
_LITERAL = re.compile(r"\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)'|`([^`\n]*)`")
_GIVEN = re.compile(r"(?:([\w.\-$]+)(?:\([^()]*\))?[\"'`]?\]?\s*)?(?:=>|[=:(,?]|\breturn)\s*$")
_JOINED_ON = re.compile(r"[\"'`]\s*\+\s*(?:\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)'|`([^`\n]*)`)")
_BESIDE = re.compile(r"\s*(?:,|[=!]=+)\s*([\w.$]+)\s*\(")
# Fixed value: last words of names whose long values are no credentials.
_NO_KEY = _OTHER_THING | frozenset(
    "alphabet certificate cert charset chars checksum commit crc etag fingerprint guid image integrity md5 revision sha sha1 sha256"
    " sha512 sum uuid version".split())
# Fixed value: what an account is called.
_ACCOUNTS = frozenset("account login user username".split())
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_WORDS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")
_GOES_ON = ("=", "(", ",", "+", ":", "\\")


def tells(name: str) -> bool:
    """Whether a name says that its value is a credential."""
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    if not parts or parts[-1] in _OTHER_THING or "public" in parts:
        return False
    pairs = zip(parts, parts[1:])
    return any(p in _TELLING or p in _JOINED for p in parts) or any(a in _KEY_KINDS and b == "key" for a, b in pairs)


def _named(text: str, start: int, end: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(name, spans of the value) of the literals in ``text[start:end]`` that a telling name is given.

    A name holds until its statement, its argument list or its block ends, or another name is given a value.
    """
    name: str | None = None
    depth = held = 0
    letters: list[tuple[int, int]] = []
    spans: list[tuple[int, int]] = []
    last_end, last_literal = start, False

    def ended() -> Iterator[tuple[str, list[tuple[int, int]]]]:
        nonlocal name, letters, spans
        if spans and name:
            yield name, spans
        if len(letters) > 4 and name:
            yield name, letters
        name, letters, spans = None, [], []

    for m in _PIECE.finditer(text, start, end):
        between = text[last_end:m.start()]
        after_literal, last_end, last_literal = last_literal, m.end(), False
        if m[5]:
            yield from ended()
            continue
        if m[6]:
            depth += 1
            continue
        if m[7]:
            depth -= 1
            if depth < held and _BLOCK.match(text, m.end(), end):
                yield from ended()  # parameters of a block
            continue
        if m[8]:
            if depth < held:
                yield from ended()
            continue
        if m[4]:
            if tells(m[4]):
                if spans:
                    yield from ended()
                name, held = m[4], depth
            elif name and not between.rstrip().endswith((":", ".")) and _ASSIGNED.match(text, m.end(), end) and "?" not in between:
                yield from ended()  # another name is given a value
            continue
        g = 1 if m[1] is not None else 2 if m[2] is not None else 3
        value = m[g]
        chosen = "?" in between
        if re.fullmatch(r"[\w.\-]+", value) and not chosen:
            after = text[m.end():min(end, m.end() + 40)]
            if tells(value) and re.match(r"\s*(?:[,:]|\]\s*=|\)?\s*=(?!=))", after):
                yield from ended()
                name, held = value, depth
                if re.match(r"\s*\]", after):
                    held -= 1
                continue
            if re.match(r"\s*(?::|\]\s*=(?!=))", after):
                yield from ended()  # the key of another entry
                continue
        last_literal = True
        if name is None or _LOOKUP.search(text[max(start, m.start() - 200):m.start()]):
            continue
        if len(value) == 1 and g == 2:
            letters.append(m.span(g))
        elif spans and (re.fullmatch(r"\s*\+\s*", between) or after_literal and re.fullmatch(r"[\s\\+]*[fFrRbBuU]{0,2}", between)):
            spans.append(m.span(g))
        else:
            if spans and name.lower() != "login":
                yield name, spans
            spans = [m.span(g)]
    yield from ended()


def _statement_end(text: str, end: int) -> int:
    """Where the statement ends that goes on at the line end ``end``."""
    while True:
        head = text[text.rfind("\n", 0, end) + 1:end].rstrip()
        more = text[end + 1:end + 200]
        if not (head.endswith(_GOES_ON) or re.match(r"\s*[+=]", more)
                or head.endswith(("\"", "'")) and re.match(r"\s*[fFrRbBuU]{0,2}[\"']", more)):
            return end
        nxt = text.find("\n", end + 1)
        if nxt < 0:
            return len(text)
        end = nxt


def _long_literals(text: str) -> Iterator[list[tuple[int, int]]]:
    """Spans of literals and settings without a blank that are long enough for a credential without a telling name.

    The pieces that are joined on to a literal belong to it.
    """
    done = -1
    for hit in _LONG.finditer(text):
        if hit.start() < done:
            continue
        start = text.rfind("\n", 0, hit.start() + 1) + 1
        end = text.find("\n", hit.start() + 1)
        done = end = len(text) if end < 0 else end
        line = text[start:end]
        m = _SETTING.match(line)
        if m and not re.search(r"[\s;({,]", m[2]):
            if not _other(m[1]):
                yield [(start + m.start(2), start + m.end(2))]
            continue
        for m in _LITERAL.finditer(line):
            g = 1 if m[1] is not None else 2 if m[2] is not None else 3
            if len(m[g]) >= BARE_LEAST and not re.search(r"\s", m[g]):
                given = _GIVEN.search(line[max(0, m.start() - 80):m.start()])
                beside = _BESIDE.match(line, m.end())  # compared with a digest
                if given and not (given[1] and _other(given[1]) or beside and _other(beside[1])):
                    spans = [(start + m.start(g), start + m.end(g))]
                    while more := _JOINED_ON.match(text, spans[-1][1]):
                        spans.append(more.span(more.lastindex))
                    yield spans


def _other(name: str) -> bool:
    """Whether a name says that its value is another thing than a credential, however it looks."""
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    return bool(parts) and (parts[-1] in _NO_KEY or "public" in parts or len(parts) > 1 and parts[-1].isdigit() and parts[-2] in _NO_KEY)


def candidates(text: str) -> list[tuple[str, int, str, list[int]]]:
    """(name, line, value, flat spans) of literals in ``text`` that may be credentials; name is blank where none tells.

    A name in angle brackets stands for a place that by itself holds credentials: <key>, <url>, <scheme>, <remark>, and
    <pair> for an account in a comment.  Literals that are given or passed on without a telling name are candidates too.
    """
    out: dict[int, tuple[str, str, list[tuple[int, int]]]] = {}
    starts: list[int] = []
    ends: list[int] = []

    def is_taken(at: int) -> bool:
        i = bisect_right(starts, at)
        return i > 0 and at < ends[i - 1]

    def take(a: int, b: int) -> None:
        if not is_taken(a):
            i = bisect_right(starts, a)
            starts.insert(i, a)
            ends.insert(i, b)

    def add(name: str, spans: list[tuple[int, int]]) -> None:
        if spans[0][0] not in out and not is_taken(spans[0][0]):
            out[spans[0][0]] = (name, "".join(text[a:b] for a, b in spans), spans)

    if "PRIVATE KEY" in text:
        for m in _KEY_BLOCK.finditer(text):
            add("<key>", [m.span()])
            take(*m.span())
    done = read = -1
    for hint in _HINT.finditer(text):
        if hint.start() < done:
            continue
        start = text.rfind("\n", 0, hint.start()) + 1
        end = text.find("\n", hint.start())
        end = len(text) if end < 0 else end
        done = end
        line = text[start:end]
        for m in _URL.finditer(line):
            g = m.lastindex
            add("<url>", [(start + m.start(g), start + m.end(g))])
            take(start + m.start(), start + m.end())
        for m in _SCHEME.finditer(line):
            add("<scheme>", [(start + m.start(1), start + m.end(1))])
            take(start + m.start(), start + m.end(1))
        if not any(c in line for c in "\"'`=:"):
            continue
        for note in _COMMENT.finditer(line):
            for m in _REMARK.finditer(note[1] or ""):
                at = start + note.start(1)
                # A login names its account first; of what else stands beside one another, any may be the value.
                for g in (2,) if m[2] and _LOGIN.match(m[0]) else (1, 2) if m[2] else (1,):
                    add("<remark>", [(at + m.start(g), at + m.end(g))])
        m = _SETTING.match(line)
        if m and tells(m[1]) and not line.rstrip().endswith((";", "(", "{", ",")):
            add(m[1], [(start + m.start(2), start + m.end(2))])
        if start >= read:
            read = _statement_end(text, end)
            for name, spans in _named(text, start, read):
                add(name, spans)
        for m in _SIGNED.finditer(line):
            add("", [(start + m.start(1), start + m.end(1))])
    for name, telling, within in (("<pair>", _PAIRED, _PAIR), ("", _RUNS, _RUN)):
        done = -1
        for hit in telling.finditer(text):
            if hit.start() < done:
                continue
            start = text.rfind("\n", 0, hit.start()) + 1
            done = text.find("\n", hit.start())
            done = len(text) if done < 0 else done
            for note in _COMMENT.finditer(text[start:done]):
                for m in within.finditer(note[1] or ""):
                    at = start + note.start(1)
                    if name and m[1].lower().split()[-1] in _ACCOUNTS or not (m[1] and _other(m[1])):
                        add(name, [(at + m.start(2), at + m.end(2))])
    inside = sorted(s for _, _, spans in out.values() for s in spans)
    for spans in _long_literals(text):
        a, b = spans[0]
        i = bisect_right(inside, (a, len(text)))
        if not (i and a < inside[i - 1][1] or i < len(inside) and inside[i][0] < b):
            add("", spans)
    rows, line_no, last = [], 1, 0
    for at, (name, value, spans) in sorted(out.items()):
        line_no += text.count("\n", last, at)
        last = at
        rows.append((name, line_no, value, [x for s in spans for x in s]))
    return rows


def residual(value: str, bits: dict[str, float], longest: int) -> int:
    """Characters of ``value`` that the best segmentation into dictionary words leaves unexplained.

    Separators are free.  ``bits`` has each word's cost; the best segmentation has the least total cost, where a
    character outside words costs :data:`UNKNOWN_BITS`.
    """
    low = value.lower()
    best: list[tuple[float, int]] = [(0.0, 0)]
    for i in range(1, len(low) + 1):
        c = low[i - 1]
        cost, left = best[i - 1]
        free = c in " \t-_.:,/\\"
        option = (cost + (0.0 if free else UNKNOWN_BITS), left + (not free))
        if c.isalpha():
            for j in range(max(0, i - longest), i - 1):
                word = bits.get(low[j:i])
                if word is not None and best[j][0] + word < option[0]:
                    option = (best[j][0] + word, best[j][1])
        best.append(option)
    return best[-1][1]


def place_of(name: str) -> str:
    """The kind of place a candidate of this name stands in; names only choose the threshold."""
    return "key" if name == "<key>" else "pair" if name == "<pair>" else "named" if name else "bare"


def is_secret(name: str, value: str, left: int) -> bool:
    """Whether a literal with ``left`` unexplained characters is a live-looking credential in its place."""
    if name == "<key>":
        return True
    if _PLACEHOLDER.search(value.strip()) or _DIGEST.match(value) or not value.strip():
        return False
    if re.search(r"\s\S+\s", value.strip()):  # running text
        return False
    place = place_of(name)
    if place != "named" and (_FIXED.match(value) or not re.search(r"[^\W\d_]", value)):
        return False
    least, share = RESIDUAL[place]
    return left >= least and left >= share * len(value)


def words_outside(text: str, spans: list[list[int]]) -> list[str]:
    """The words of ``text`` outside of the candidates' values, which must not explain themselves."""
    kept, at = [], 0
    for a, b in sorted((s[i], s[i + 1]) for s in spans for i in range(0, len(s), 2)):
        if b > at:
            kept.append(text[at:a])
            at = b
    return _WORDS.findall(" ".join([*kept, text[at:]]) if kept else text)


def swept(owners: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """One pass over all texts: rows of word counts and rows of candidates.

    ``owners`` lists (owner, table, id column, text column).  Null ids and texts give no row.  Each word comes with the
    least and the greatest context in which it stands: the project, or the text itself in tables without projects.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: dict[int, Counter[str]] = {}
            rows = []
            for owner, i, key, context, text in zip(
                    pdf["owner"], pdf["owner_id"], pdf["text_key"], pdf["context"], pdf["text"]):
                found = candidates(text)
                counts.setdefault(context, Counter()).update(words_outside(text, [c[3] for c in found]))
                rows += [(owner, i, key, *c) for c in found]
            low: dict[str, list[int]] = {}
            for context, each in sorted(counts.items()):
                for w, n in each.items():
                    if (seen := low.get(w := w.lower())) is None:
                        low[w] = [n, context, context]
                    else:
                        seen[0] += n
                        seen[2] = context
            if low:
                yield pd.DataFrame([(w, *x) for w, x in low.items()], columns=["word", "n", "lo", "hi"]).assign(
                    owner=None, owner_id=None, text_key=None, name=None, line_no=None, value=None, spans=None)
            if rows:
                yield pd.DataFrame(rows, columns=["owner", "owner_id", "text_key", "name", "line_no", "value", "spans"]).assign(
                    word=None, n=None, lo=None, hi=None)

    texts = None
    for owner, df, key, text in owners:
        context = F.xxhash64(F.coalesce("project", F.lit(""))) if "project" in df.columns else F.xxhash64(text)
        part = df.select(F.lit(owner).alias("owner"), F.col(key).cast("bigint").alias("owner_id"), F.xxhash64(text).alias("text_key"),
                         context.alias("context"), F.col(text).alias("text"))
        part = part.where("owner_id is not null and text is not null")
        texts = part if texts is None else texts.unionByName(part)
    return texts.mapInPandas(run, "word string, n bigint, lo bigint, hi bigint, owner string, owner_id bigint, text_key bigint, name string,"
                                  " line_no int, value string, spans array<int>")


def judged_candidates(owners: list[tuple[str, DataFrame, str, str]], dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
    """(owner, owner_id, text_key, line_no, value, spans, place, left, accepted): every candidate and what the dictionary leaves of it.

    ``spans`` are flat code point offsets, ``left`` is the residual.

    The dictionary has the ``dictionary_words`` most frequent words of all texts, a bounded parameter.  Words are counted
    outside of the candidates' values and explain only if they stand in two projects, however often one of them or its
    copies repeat them; a corpus of one project has no other to compare with and counts them all.  An id that was delivered more than once gives
    each place of each of its texts once, and ``text_key`` is the hash of that text.
    """
    rows = written(swept(owners), "sweep")
    counted = rows.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ends = counted.agg(F.min("lo"), F.max("hi")).first()
    if ends[0] != ends[1]:
        counted = counted.where("lo <> hi")
    words = counted.orderBy(F.desc("n"), "word").limit(dictionary_words).collect()
    total = sum(r.n for r in words) or 1
    bits = {r.word: math.log2(total / r.n) + 2 for r in words}
    longest = max(map(len, bits), default=1)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("struct<place: string, left: int, accepted: boolean>")
    def judged(name: pd.Series, value: pd.Series) -> pd.DataFrame:
        known, out = shared.value, []
        for n, v in zip(name, value):
            left = 0 if n == "<key>" else residual(v, known, longest)
            out.append((place_of(n), left, is_secret(n, v, left)))
        return pd.DataFrame(out, columns=["place", "left", "accepted"])

    places = rows.where("owner is not null").select("owner", "owner_id", "text_key", "name", "line_no", "value", "spans")
    places = places.dropDuplicates(["owner", "owner_id", "text_key", "spans"])
    return places.withColumn("j", judged("name", "value")).select(
        "owner", "owner_id", "text_key", "line_no", "value", "spans", "j.place", "j.left", "j.accepted")


def secrets(owners: list[tuple[str, DataFrame, str, str]], dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
    """(owner, owner_id, text_key, line_no, value, spans): the credentials of all texts; see :func:`judged_candidates`."""
    return judged_candidates(owners, dictionary_words).where("accepted").drop("place", "left", "accepted")


def decisions(candidates: DataFrame) -> DataFrame:
    """(owner, place, candidates, explained, excluded, secrets) of judged candidates.

    ``explained`` are those the dictionary leaves too little of, ``excluded`` are placeholders, digests and running text
    that would have had enough left.
    """
    least = F.create_map(*[F.lit(x) for k, v in RESIDUAL.items() for x in (k, v[0])])
    share = F.create_map(*[F.lit(x) for k, v in RESIDUAL.items() for x in (k, v[1])])
    enough = F.coalesce((F.col("left") >= least[F.col("place")]) & (F.col("left") >= share[F.col("place")] * F.char_length("value")), F.lit(True))
    return candidates.groupBy("owner", "place").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(~enough).alias("explained"),
        F.count_if(enough & ~F.col("accepted")).alias("excluded"), F.count_if("accepted").alias("secrets"))


_KEY_TEXT = re.compile(r"[A-Za-z0-9+/=]{16,}")


def blanked(text: str, spans: list[int]) -> str:
    """``text`` with the spans' characters replaced by x; length, line ends and quotes stay, so code still parses."""
    out, at = [], 0
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        a = max(a, at)
        if a >= b:
            continue
        part = text[a:b]
        keyed = part.startswith("-----BEGIN")
        out += [text[at:a], _KEY_TEXT.sub(lambda m: "x" * len(m.group()), part) if keyed else "x" * len(part)]
        at = b
    return "".join(out) + text[at:]


def redacted(owner: str, table: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """(owner, owner_id, n_secrets, text): each text that holds credentials, with these blanked.

    Different deliveries of one id are blanked each by its own spans; repeated rows come out once.  ``n_secrets`` counts
    places; of places that overlap, the outer one counts.
    """
    per = found.where(F.col("owner") == owner).groupBy("owner", "owner_id", "text_key").agg(F.collect_list("spans").alias("spans"))
    texts = table.select(F.col(key).cast("bigint").alias("owner_id"), F.col(text).alias("text")).where(
        "text is not null").distinct().withColumn("text_key", F.xxhash64("text"))

    @F.pandas_udf("struct<n_secrets: bigint, text: string>")
    def blank(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, each in zip(text, spans):
            outer, end = 0, -1
            for a, b in sorted((s[0], s[-1]) for s in each):
                outer += a >= end
                end = max(end, b)
            out.append((outer, blanked(t, [int(x) for s in each for x in s])))
        return pd.DataFrame(out, columns=["n_secrets", "text"])

    return texts.join(per, ["owner_id", "text_key"]).select("owner", "owner_id", blank("text", "spans").alias("b")).select(
        "owner", "owner_id", "b.n_secrets", "b.text")
