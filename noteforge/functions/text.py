"""Column functions on notes: links, frontmatter, tags, sections, paths, cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteforge import vocab

WIKI, MD = r"\[\[([^\]]+)\]\]", r"!?\[([^\]]*)\]\(([^)]+)\)"
STRIP = r"^[\s\x{A0}]+|[\s\x{A0}]+$"


def one_newline(text: Column) -> Column:
    """\\r\\n and \\r as \\n."""
    return F.regexp_replace(text, "\r\n?", "\n")


BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"


def lines(text: Column) -> Column:
    """Lines as Python's splitlines() gives them: no empty one behind a final break."""
    parts = F.split(text, BREAK)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def all_groups(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def wiki_links(text: Column) -> Column:
    """Targets of [[links]], without aliases and blanks."""
    return F.filter(F.transform(all_groups(text, WIKI), lambda x: strip(F.split_part(x, F.lit("|"), F.lit(1)))), lambda x: x != "")


def md_links(text: Column) -> Column:
    """(alt, url) of [links](url) and images."""
    return F.arrays_zip(all_groups(text, MD, 1).alias("alt"), all_groups(text, MD, 2).alias("url"))


def attachment_path(link: Column) -> Column:
    """What follows the last 'attachments/', without ../ and a query; null without it."""
    tail = F.element_at(F.split(link, "(?i)attachments/"), -1)
    return F.when(F.lower(link).contains("attachments/"), F.split_part(F.replace(tail, F.lit("../"), F.lit("")), F.lit("?"), F.lit(1)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def duplicate_name(name: Column) -> tuple[Column, Column]:
    """Base and number of 'base (n).md'; the stem and 0 of other names."""
    base, n = (F.regexp_extract(name, r"^(.+) \(([0-9]+)\)\.md$", g) for g in (1, 2))
    return F.when(base != "", base).otherwise(F.regexp_replace(name, r"\.md$", "")), F.when(base != "", n.try_cast("long")).otherwise(F.lit(0).cast("long"))


def frontmatter_block(text: Column) -> Column:
    """The block from a leading --- to a line --- with blanks, both included; empty without."""
    return F.regexp_extract(text, r"(?s)\A(---.*?\n---\s*\n)", 1)


def frontmatter_lines(text: Column) -> Column:
    """The lines between a leading --- and the first line that is ---; null without."""
    return F.when(text.startswith("---") & (F.locate("\n---\n", text, 4) > 0), F.split(strip(F.substring(text, F.lit(4), F.locate("\n---\n", text, 4) - 4)), "\n"))


def front_rows(text: Column) -> Column:
    """The lines behind the first up to a line that is --- between blanks; all of them without such a line."""
    rows = F.split(text, "\n")
    after = F.slice(rows, F.lit(2), F.size(rows))
    end = F.array_position(F.transform(after, strip), "---").cast("int")
    return F.when(end > 0, F.slice(after, F.lit(1), end - 1)).otherwise(after)


def frontmatter_map(text: Column) -> Column:
    """Keys and values of frontmatter_lines, each line cut at its first colon, a later key winning (LAST_WIN)."""
    kv = F.transform(F.filter(frontmatter_lines(text), lambda x: x.contains(":")), lambda x: F.struct(strip(F.split_part(x, F.lit(":"), F.lit(1))), strip(F.substring(x, F.locate(":", x) + 1, F.length(x)))))
    unique = F.aggregate(kv, F.from_json(F.lit("{}"), "map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["col1"]), F.map_from_entries(F.array(x))))
    return unique


def any_dash_end(text: Column) -> Column:
    """Offset behind the first --- after a leading one, anywhere; 0 without."""
    at = F.locate("---", text, 4)
    return F.when(text.startswith("---") & (at > 0), at + 2).otherwise(0)


def has_frontmatter(text: Column) -> Column:
    return strip(F.split_part(text, F.lit("\n"), F.lit(1))) == "---"


def quoted_field(text: Column, key: str) -> Column:
    """The value of `key:` in a block between --- lines, with or without quotes; null without."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    return F.nullif(F.regexp_extract(block, rf'(?md)^{key}:[ \t]*"?([^"\n]+)"?[ \t]*$', 1), F.lit(""))


def inline_tags(text: Column) -> Column:
    """The `tags: [...]` of a text, null without."""
    return F.nullif(F.regexp_extract(text, r"(?md)^tags:\s*\[[^\]]+\]", 0), F.lit(""))


def tag_list(found: Column) -> Column:
    """The tags between brackets, without quotes and empty ones."""
    inner = F.split(F.regexp_extract(found, r"\[([^\]]+)\]", 1), ",")
    return F.filter(F.transform(inner, lambda x: F.regexp_replace(strip(x), "^['\"]+|['\"]+$", "")), lambda x: x != "")


def map_tags(tags: Column) -> Column:
    """Structs (tag, mapped): approved tags stay, then the dictionary (null: dropped), then topic/ before the tag."""
    approved = F.lit(vocab.APPROVED_TAGS)
    keys, values = F.lit(list(vocab.TAG_MAPPING)), F.array(*[F.lit(v) for v in vocab.TAG_MAPPING.values()])
    mapped = lambda t: (
        F.when(F.array_contains(approved, t), t)
        .when(F.array_contains(keys, t), F.element_at(values, F.array_position(keys, t).cast("int")))
        .when(F.array_contains(approved, F.concat(F.lit("topic/"), t)), F.concat(F.lit("topic/"), t))
    )
    return F.transform(tags, lambda t: F.struct(t.alias("tag"), mapped(t).alias("mapped")))


def yaml_tags(tags: Column) -> Column:
    """tags as a YAML list, sorted and distinct."""
    ordered = F.sort_array(F.array_distinct(tags))
    return F.when(F.size(ordered) == 0, "tags: []").otherwise(F.concat(F.lit("tags:\n  - "), F.array_join(ordered, "\n  - ")))


#: Fixed values. Order matters: an address goes first and takes a closing bracket with it; images come when links have gone.
CLEANING = [
    (r"(?s)##\s*Curator Summary.*?(?=\n---\s*\n)", ""), (r"(?s)```.*?```", ""), (r"(?s)~~~.*?~~~", ""), (r"`[^`]+`", ""),
    (r"https?://\S+", ""), (r"\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"), (r"\[\[([^\]]+)\]\]", "$1"),
    (r"<[^>]+>", ""), (r"(?m)^#+\s*", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"__([^_]+)__", "$1"),
    (r"_([^_]+)_", "$1"), (r"!\[\[.*?\]\]", ""), (r"!\[.*?\]\(.*?\)", ""), (r"\s+", " "),
]


def body_of(text: Column) -> Column:
    return F.substring(text, F.length(frontmatter_block(text)) + 1, F.length(text))


def plain_text(text: Column) -> Column:
    """The body without markup, as language detection reads it."""
    return F.regexp_replace(reduce(lambda t, p: F.regexp_replace(t, "(?dU)" + p[0], p[1]), CLEANING, body_of(text)), "^ | $", "")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def indicators(text: Column) -> tuple[Column, Column]:
    """Spanish and English signs: distinct words of the lists, and each Spanish character."""
    words = word_set(text)
    spanish = F.size(F.array_intersect(words, F.lit(vocab.SPANISH_WORDS))) + F.regexp_count(text, F.lit(f"[{vocab.SPANISH_CHARACTERS}]"))
    return spanish, F.size(F.array_intersect(words, F.lit(vocab.ENGLISH_WORDS)))


def language_decision(text: Column, best: Column, prob: Column, signs: tuple[Column, Column] | None = None) -> tuple[Column, Column]:
    """Language and confidence from a model's best guess (null and 0 without a model) and the signs in the text. signs:
    its indicators() as columns, which are read a dozen times here; without, each time counts them anew."""
    es, en = signs or indicators(text)
    total, unsure = (es + en).cast("double"), prob < 0.7
    es_wins, en_wins = unsure & (total > 5) & (es > en * F.lit(1.5)), unsure & (total > 5) & (en > es * F.lit(1.5))
    tie = unsure & best.isNotNull()
    es_tie, en_tie = tie & (((best == "es") & (es >= en)) | (~((best == "en") & (en >= es)) & (es > en * 2))), tie & (((best == "en") & (en >= es)) | (~((best == "es") & (es >= en)) & (en > es * 2)))
    sure = (best == "es") & (es >= en) | (best == "en") & (en >= es)
    short = F.length(text) < 50
    lang = F.when(short, F.lit(None).cast("string")).when(es_wins | (~en_wins & es_tie), "es").when(en_wins | en_tie, "en").otherwise(best)
    conf = F.when(short, 0.0).when(es_wins, F.least(F.lit(0.9), es / total)).when(en_wins, F.least(F.lit(0.9), en / total)).when(es_tie | en_tie, F.when(sure, F.greatest(prob, F.lit(0.6))).otherwise(0.6)).otherwise(prob)
    return lang, conf


def language_tag(front: Column) -> Column:
    return F.nullif(F.regexp_extract(front, "lang/(en|es)", 1), F.lit(""))


#: A list under tags:, written so that it neither backtracks nor recurses, whatever its length.
TAG_LINES = r"(?md)^tags:[ \t]*+\n((?:[ \t]*+-[^\n]+\n)++)"


def with_language(text: Column, lang: Column) -> Column:
    """The note with its lang/ tag set: replaced in the quoting style that it has, or put at the end of its tag list. A
    list of lines takes a closing --- right behind it for its last item, as the tool that this matches does."""
    front, body = frontmatter_block(text), body_of(text)
    now = language_tag(front)
    inline, inner, items = F.regexp_extract(front, r"(?sm)^tags:\s*\[.*?\]", 0), F.regexp_extract(front, r"(?sm)^tags:\s*\[(.*?)\]", 1), F.regexp_extract(front, TAG_LINES, 1)
    tag = F.concat(F.lit("'lang/"), lang, F.lit("'"))
    fresh = F.when(strip(inner) == "", tag).otherwise(F.concat(F.regexp_replace(inner, r"\s+$", ""), F.lit(", "), tag))
    at = F.locate("[", inline)
    added = F.replace(front, inline, F.concat(F.substring(inline, F.lit(1), at), fresh, F.lit("]")))
    below = F.replace(front, items, F.concat(items, F.lit("  - lang/"), lang, F.lit("\n")))
    swap = lambda q: F.replace(front, F.concat(F.lit(f"{q}lang/"), now, F.lit(q)), F.concat(F.lit(f"{q}lang/"), lang, F.lit(q)))
    has = lambda q: F.contains(front, F.concat(F.lit(f"{q}lang/"), now, F.lit(q)))
    changed = F.when(has("'"), swap("'")).when(has('"'), swap('"')).otherwise(swap(""))
    new = F.when(now.isNull(), F.when(inline != "", added).when(items != "", below).otherwise(front)).when(now != lang, changed).otherwise(front)
    return F.when(lang.isNull() | (front == ""), text).otherwise(F.concat(new, body))


def archive_language(text: Column) -> Column:
    sample = F.lower(F.left(text, F.lit(2000)))
    padded = F.concat(F.lit(" "), sample, F.lit(" "))
    words = reduce(lambda a, b: a + b, [F.contains(padded, F.lit(f" {w} ")).cast("int") for w in vocab.ARCHIVE_SPANISH_WORDS])
    spanish = (F.regexp_count(sample, F.lit("[áéíóúñü]")) >= 3) | (words >= 5) | sample.rlike("[¿¡]")
    return F.when(F.coalesce(spanish, F.lit(False)), "lang/es").otherwise("lang/en")


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def archive_kind(name: Column) -> Column:
    low, out = F.lower(name), F.lit("type/note")
    for kind, words in reversed(vocab.ARCHIVE_KINDS.items()):
        out = F.when(any_of(low, words), kind).otherwise(out)
    return out


def archive_topics(name: Column, text: Column) -> Column:
    """Sorted distinct topics by words in the first 2000 characters; a chat is about AI."""
    low = F.lower(F.left(text, F.lit(2000)))
    found = [F.when(any_of(low, words), topic) for topic, words in vocab.ARCHIVE_TOPICS.items()]
    chat = F.when(any_of(F.lower(name), vocab.ARCHIVE_KINDS["type/chatgpt-conversation"]), "topic/ai")
    return F.sort_array(F.array_distinct(F.array_compact(F.array(chat, *found))))


def usefulness(name: Column, text: Column) -> Column:
    low, score = F.lower(name), F.lit(0.5)
    for words, value in vocab.ARCHIVE_SCORES:
        score = F.when(any_of(low, words), F.lit(value)).otherwise(score)
    score = F.when(F.length(text) > 5000, score + F.lit(0.15)).when(F.length(text) < 500, score - F.lit(0.15)).otherwise(score)
    score = F.when((F.length(text) - F.length(F.replace(text, F.lit("\n## "), F.lit("")))) / 4 > 2, score + F.lit(0.1)).otherwise(score)
    return F.greatest(F.lit(0.3), F.least(F.lit(0.9), score))


def score_text(score: Column) -> Column:
    out = F.lit("0.9")
    for op, bound, shown in reversed(vocab.SCORE_TEXT):
        out = F.when(score <= bound if op == "<=" else score < bound, shown).otherwise(out)
    return out


def archive_frontmatter(name: Column, text: Column, date: str) -> Column:
    tags = F.sort_array(F.array_distinct(F.concat(F.array(archive_kind(name), archive_language(text), F.lit("status/archived")), archive_topics(name, text))))
    return F.concat(F.lit(f'---\ndate: "{date}"\ntags:\n  - '), F.array_join(tags, "\n  - "), F.lit("\nusefulness: "), score_text(usefulness(name, text)), F.lit("\n---\n"))


REFLECTION = "\n## My Thoughts\n\n*Add your thoughts here*\n\n## Related Notes\n\n*No related notes identified*\n\n---\n\n"


def with_reflection(text: Column) -> Column:
    return F.when(text.contains("# My Thoughts"), text).otherwise(F.concat(F.lit(REFLECTION), text))


def section(text: Column, heading: str) -> Column:
    """What stands below `## heading` up to the next section, rule or end, stripped."""
    return strip(F.regexp_extract(text, rf"(?sd)## {heading}\n\n(.*?)(?=\n## |\n---|\z)", 1))


def has_diagram(text: Column) -> Column:
    return text.rlike(r"(?id)!\[\[.*diagram.*\]\]|!\[.*diagram.*\]\(.*\)|!\[\[.*\.excalidraw.*\]\]|```mermaid")


def has_transcript(text: Column) -> Column:
    return text.rlike(r"(?i)##\s+(audio\s+)?transcript")


def with_embed(text: Column, embed: Column) -> Column:
    """embed and an empty line behind the first overview heading; the text itself without one."""
    found = F.regexp_extract(text, r"(?d)## (?:Chapter|Book|Part) Overview\n", 0)
    at = F.instr(text, found)
    return F.when(found == "", text).otherwise(F.concat(F.substring(text, F.lit(1), at + F.length(found) - 1), F.lit("\n"), embed, F.lit("\n"), F.substring(text, at + F.length(found), F.length(text))))


def safe_name(title: Column) -> Column:
    return F.replace(strip(F.regexp_replace(title, r"[^\p{L}\p{N}_\s-]", "")), F.lit(" "), F.lit("_"))


EXTENSIONS = "png|jpg|jpeg|gif|webp|svg|heic|pdf|bin|txt|md|html|csv|zip|tar|gz|mp4|mov|m4a"


#: A line that begins with a slash, without what stands around it; a run of characters that a bare name is made of, with
#: a dot in it. Both are read in one pass, whatever the text's length.
BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
SLASH_LINE = rf"(?:\A|[{BREAKS}])[\t \x{{A0}}]*+(/[^{BREAKS}]*+)"
DOTTED = r"[^\s)\]\"'.]*+\.[^\s)\]\"']*+"


def extracted_paths(text: Column) -> Column:
    """Paths in a note, first come first: links, bracketed, quoted, at a line's start, absolute, in <>, bare names."""
    clean = lambda xs: F.filter(F.transform(xs, strip), lambda x: x != "")
    wiki = F.transform(all_groups(text, WIKI), lambda x: F.split_part(strip(x), F.lit("|"), F.lit(1)))
    starts = F.transform(all_groups(text, SLASH_LINE), lambda x: F.regexp_replace(strip(x), "[,.]+$", ""))
    angle = F.filter(clean(all_groups(text, "<([^>]+)>")), lambda x: x.contains("/") | x.rlike(r"\.[A-Za-z0-9]{2,6}$"))
    named = F.filter(all_groups(text, DOTTED, 0), lambda x: x.rlike(rf"(?i)\.(?:{EXTENSIONS})\b"))
    bare = F.flatten(F.transform(named, lambda x: F.regexp_extract_all(x, F.lit(rf"(?i)\b([^\s)\]\"']+\.(?:{EXTENSIONS}))\b"), F.lit(1))))
    parts = [clean(wiki), clean(all_groups(text, r"\((/[^)]+)\)")), clean(all_groups(text, r"`(/[^`]+)`")), clean(starts), clean(all_groups(text, r"(/Users[^\s)\]]+|/[^\s)\]]+)")), angle, clean(bare)]
    return F.array_distinct(F.concat(*parts))


def resolved_path(path: Column, base: str) -> Column:
    """Absolute under known roots, else below base; . and .. and double slashes are taken out."""
    known = path.rlike("^/(Users|home|Volumes)")
    whole = F.when(known, path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(path, "^/+", "")))
    parts = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    return F.when(known, path).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def renamed_links(text: Column, old: Column, new: Column) -> Column:
    """old as new in embeds ![[old]], with or without an alias, and where a link's address ends with it."""
    quoted, safe = F.concat(F.lit(r"\Q"), old, F.lit(r"\E")), F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    wiki = F.regexp_replace(text, F.concat(F.lit(r"!\[\["), quoted, F.lit(r"(\|[^\]]*)?\]\]")), F.concat(F.lit("![["), safe, F.lit("$1]]")))
    return F.regexp_replace(wiki, F.concat(F.lit(r"\]\(([^)]*)"), quoted, F.lit(r"\)")), F.concat(F.lit("]($1"), safe, F.lit(")")))


#: A message of either side.
USER = r"(?sd)###\s+User,\s+on\s+([^;]+?);?\s*\n>\s*(.+?)(?=\n###|\n####|\n<details>|\n---|\z)"
ASSISTANT = r"(?sd)####\s+ChatGPT,\s+on\s+([^;]+?);?\s*\n>>\s*(.+?)(?=\n###|\n####|\n<details>|\n---|\z)"


def transcript_messages(text: Column) -> Column:
    """Structs (role, stamp, content): all users' messages, then all answers."""
    side = lambda role, p: F.transform(F.arrays_zip(all_groups(text, p, 1).alias("s"), all_groups(text, p, 2).alias("c")), lambda x: F.struct(F.lit(role).alias("role"), strip(x["s"]).alias("stamp"), strip(x["c"]).alias("content")))
    return F.concat(side("user", USER), side("assistant", ASSISTANT))


def title(text: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(strip(F.regexp_extract(text, r"(?md)^#\s+(.+)$", 1)), F.lit("")), default)


def shown_title(title: Column) -> Column:
    return F.replace(title, F.lit("Title: "), F.lit(""))


def stamps(at: Column) -> tuple[Column, Column]:
    """A time as runs and as notes write it: 20240131_235959, 2024-01-31."""
    return F.date_format(at, "yyyyMMdd_HHmmss"), F.date_format(at, "yyyy-MM-dd")


def preview(text: Column, budget: int = 3000) -> Column:
    """The text behind a title at its very start, up to the end of the line that the budget's last character stands in; a
    mark below it if lines follow."""
    rest = F.regexp_replace(text, r"(?d)\A#\s+.+\n", "")
    end = F.locate("\n", rest, budget)
    return F.when(end > 0, F.concat(F.left(rest, end - 1), F.lit("\n\n[... conversation continues ...]"))).otherwise(rest)


def is_hidden(path: Column, policy: str = "shared") -> Column:
    """Whether a vault-relative path is left out. shared: any part with a leading dot; inverted: those but .trash and
    .obsidian; fallback: those two alone; strict: as shared, without opt-ins; none: nothing."""
    parts = F.split(path, "/")
    own = F.exists(parts, lambda p: p.isin(".trash", ".obsidian"))
    dotted = F.exists(parts, lambda p: p.startswith("."))
    return {"shared": dotted, "strict": dotted, "inverted": dotted & ~own, "fallback": own, "none": F.lit(False)}[policy]
