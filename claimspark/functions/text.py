"""String, URL and identity expressions; all of them built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the separator of identity parts.
UNIT = "\x1f"
#: Query keys that only track, besides those that begin with utm_.
TRACKING = ("rdid", "mibextid", "ref", "refsrc", "sfnsn", "__tn__", "eid")
#: Words after an act's name that don't tell it apart.
ACT_SUFFIXES = ("band", "duo", "trio", "live", "acoustic", "show", "music")
POSTCODE = r"(?i)\b[a-z]{1,2}[0-9][0-9a-z]?\s*[0-9][a-z]{2}\b"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trimmed(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def present(x: Column) -> Column:
    """The trimmed text, or null where nothing is left: absent, null and empty are one."""
    return F.nullif(trimmed(x), F.lit(""))


def slug(x: Column) -> Column:
    """Lower-case letters and digits joined by single dashes; apostrophes vanish."""
    x = F.regexp_replace(F.lower(F.trim(x)), "['’]", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9\s-]", ""), r"\s+", "-")
    return F.regexp_replace(F.regexp_replace(x, "-+", "-"), "^-|-$", "")


def place_slug(x: Column) -> Column:
    """A place's slug without postcode: whatever isn't a letter or digit parts words."""
    x = F.regexp_replace(F.lower(F.regexp_replace(x, POSTCODE, "")), "['‘’]", "")
    return F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-|-$", "")


def act_name(x: Column) -> Column:
    """Without the one word of ACT_SUFFIXES that may end it."""
    ends = F.lower(x).rlike(f" ({'|'.join(ACT_SUFFIXES)})$")
    return F.when(ends, trimmed(F.regexp_replace(x, rf"(?i) ({'|'.join(ACT_SUFFIXES)})$", ""))).otherwise(x)


def place_name(x: Column) -> Column:
    """A place's name with straight apostrophes, without postcode, and ``in Town`` as ``, Town``."""
    x = F.regexp_replace(F.regexp_replace(trimmed(x), "[\u2018\u2019\u201a\u201b]", "'"), rf"\s*{POSTCODE}\s*", "")
    return F.regexp_replace(trimmed(x), r"(?i)\s+in\s+(\w+)$", ", $1")


def squeezed(x: Column) -> Column:
    """Trimmed, with straight apostrophes and single spaces."""
    return F.regexp_replace(F.regexp_replace(trimmed(x), "[\u2018\u2019]", "'"), r"(?U)\s+", " ")


def safe_segment(x: Column, allowed: str = "A-Za-z0-9._-") -> Column:
    """Every other character as _, for keys and paths."""
    return F.regexp_replace(x, f"[^{allowed}]", "_")


def shortened(x: Column, most: int = 800) -> Column:
    """The first ``most`` characters, and an ellipsis if there are more."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("\u2026"))).otherwise(x)


def one_line(x: Column, most: int = 1600) -> Column:
    return F.substring(trimmed(F.regexp_replace(x, r"(?U)\s+", " ")), 1, most)


def last_word(x: Column, otherwise: str) -> Column:
    """The last of several words; one word alone names no place."""
    words = F.split(trimmed(x), r"(?U)\s+")
    return F.when(F.size(words) > 1, F.element_at(words, -1)).otherwise(otherwise)


def first_contained(x: Column, names: list[str] | tuple[str, ...]) -> Column:
    """The first of ``names``, in their order, that the text contains in any case; else null."""
    return let(F.lower(x), lambda low: F.coalesce(*(F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in names)))


def begins_with_any(x: Column, prefixes: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | F.startswith(x, F.lit(prefix))
    return out


def without_prefix(x: Column, prefix: Column) -> Column:
    return F.when(F.startswith(x, prefix), F.substr(x, F.length(prefix) + 1)).otherwise(x)


def wire_value(x: Column, names: dict[str, str]) -> Column:
    """A display value as its wire value; others are null."""
    return F.create_map(*[F.lit(v) for pair in names.items() for v in pair])[x]


def vocabulary(values: Column, allowed: list[str] | tuple[str, ...], partial: bool = True) -> Column:
    """Each of an array of values as the word of ``allowed`` that equals it in any case, or else the first of which either contains the other.

    Others are left out, repeats stay; an empty value is contained in the first word.
    """
    words = F.array(*map(F.lit, allowed))

    def known(x: Column) -> Column:
        equal = F.try_element_at(F.filter(words, lambda w: F.lower(w) == F.lower(x)), F.lit(1))
        near = F.try_element_at(F.filter(words, lambda w: F.contains(F.lower(w), F.lower(x)) | F.contains(F.lower(x), F.lower(w))), F.lit(1))
        return F.coalesce(equal, near) if partial else equal

    return F.array_compact(F.transform(F.coalesce(values, F.array().cast("array<string>")), known))


def content_kind(mime: Column) -> Column:
    """csv, json, html or text by what the content type contains."""
    has = lambda part: F.contains(F.lower(F.coalesce(mime, F.lit(""))), F.lit(part))
    return F.when(has("csv"), "csv").when(has("json"), "json").when(has("html"), "html").otherwise("text")


def extension_of(kind: Column) -> Column:
    return F.when(kind.isin("csv", "html", "json"), kind).otherwise("txt")


def json_string(x: Column) -> Column:
    """A text as JSON writes it."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def match_key(x: Column) -> Column:
    """Lower-case words for comparison of names."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def identity(prefix: str, *parts: Column, width: int = 32, separator: str = UNIT) -> Column:
    """prefix + the first ``width`` hex digits of the SHA-256 of the joined parts; a null part is empty, never skipped."""
    joined = F.concat(*[c for p in parts for c in (F.lit(separator), F.coalesce(p.cast("string"), F.lit("")))][1:])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, width))


def plain_text(html: Column) -> Column:
    """Tags become line feeds, then seven entities are read one after the other."""
    out = F.regexp_replace(html, r"<[^>]+>", "\n")
    for entity, letter in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.regexp_replace(out, f"(?i){entity}", letter)
    return out


ADDRESS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)"


def canonical_url(url: Column) -> Column:
    """Without fragment, tracking keys, default port and one trailing slash; scheme and host in lower case, other keys in order.

    What is no address with a host is only trimmed.
    """
    def cut(bare: Column) -> Column:
        at = F.regexp_extract(bare, ADDRESS, 2)
        rest = F.split(F.regexp_replace(bare, ADDRESS, ""), r"\?", 2)
        user, host = F.regexp_extract(at, "^(.*@)", 1), F.lower(F.regexp_replace(at, "^.*@", ""))
        return F.struct(F.lower(F.regexp_extract(bare, ADDRESS, 1)).alias("scheme"), user.alias("user"), host.alias("host"), F.element_at(rest, 1).alias("path"), F.coalesce(F.try_element_at(rest, F.lit(2)), F.lit("")).alias("query"))

    def whole(x: Column) -> Column:
        port = F.when(x["scheme"] == "http", ":80$").when(x["scheme"] == "https", ":443$").otherwise("^$")
        kept = F.filter(F.split(x["query"], "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*TRACKING) & ~F.startswith(p, F.lit("utm_")))
        tail = F.when(F.size(kept) > 0, F.concat(F.when(x["path"] == "", "/").otherwise(x["path"]), F.lit("?"), F.array_join(kept, "&"))).otherwise(x["path"])
        return F.regexp_replace(F.concat(x["scheme"], F.lit("://"), x["user"], F.regexp_replace(x["host"], port, F.lit("")), tail), "/$", "")

    clean = F.trim(url)
    bare = F.regexp_replace(clean, "#.*$", "")
    return F.when(bare.rlike(ADDRESS), let(let(bare, cut), whole)).otherwise(clean)


def host(url: Column) -> Column:
    """Lower-case host without one leading www. or m."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^(www|m)\.", "")


def target_kind(url: Column, mime: Column | None = None, image: Column | None = None) -> Column:
    """What a shared link leads to: the first rule that fits; only http and https addresses are links."""
    return let(F.trim(url), lambda link: _target_kind(link, mime, image))


def _target_kind(url: Column, mime: Column | None, image: Column | None) -> Column:
    at = F.when(url.rlike(r"(?i)^https?://[^/?#\s]"), host(url)).otherwise("")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), "/+$", "")
    picture = F.coalesce(image, F.lit(False)) if image is not None else F.lit(False)
    picture = picture | F.coalesce(F.startswith(F.lower(mime), F.lit("image/")), F.lit(False)) if mime is not None else picture
    book = (at == "facebook.com") | F.endswith(at, F.lit(".facebook.com"))
    gram = (at == "instagram.com") | F.endswith(at, F.lit(".instagram.com"))
    return (
        F.when(picture, "image").when(F.coalesce(at, F.lit("")) == "", "unknown").when((at == "fb.me") & path.rlike("(?i)^/e/"), "facebook_event_short")
        .when(book & path.rlike("(?i)(^|/)events(/|$)"), "facebook_event").when(book & path.rlike("(?i)^/share(/|$)"), "facebook_share").when(book, "facebook_url")
        .when(gram, "instagram_url").otherwise("generic_url")
    )


def object_type(kind: Column) -> Column:
    """The platform's object behind a target kind; a share link's is unknown until its redirect is followed."""
    return F.when(kind == "image", "poster").when(kind.isin("facebook_event", "facebook_event_short"), "event").when(kind.isin("unknown", "facebook_share"), "unknown").otherwise("url")


def refined_kind(kind: Column, resolved: Column) -> Column:
    """A share link's kind after its redirect: an event or a page of the same platform; all other kinds stay."""
    after = target_kind(resolved)
    return F.when((kind == "facebook_share") & after.isin("facebook_event", "facebook_url"), after).otherwise(kind)


def page_urls(links: Column) -> Column:
    """The distinct pages of one platform in a list of links, without query and one trailing slash, in their order; its searches are none."""
    lower = lambda x: F.lower(x)
    pages = F.filter(links, lambda x: F.contains(lower(x), F.lit("facebook.com/")) & ~F.contains(lower(x), F.lit("facebook.com/search")))
    return F.array_distinct(F.transform(pages, lambda x: F.regexp_replace(F.regexp_replace(x, r"\?[^#]*", ""), "/$", "")))


#: Parts of hosts that are nobody's own site.
FOREIGN_HOSTS = (
    "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "spotify.com", "soundcloud.com", "bandcamp.com", "songkick.com", "bandsintown.com",
    "setlist.fm", "last.fm", "wikipedia.org", "discogs.com", "allmusic.com", "gigantic.com", "ticketmaster.", "eventbrite.",
)


def own_sites(links: Column, name: Column, foreign: tuple[str, ...] = FOREIGN_HOSTS) -> Column:
    """The distinct scheme and host of links whose host holds the name's letters and digits, or the other way round."""
    key = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    at = lambda x: F.lower(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    letters = lambda x: F.regexp_replace(at(x), "[^a-z0-9]", "")

    def own(x: Column) -> Column:
        other = F.lit(False)
        for part in foreign:
            other = other | F.contains(at(x), F.lit(part))
        return (at(x) != "") & ~other & (F.contains(letters(x), key) | F.contains(key, F.replace(letters(x), F.lit("www"), F.lit(""))))

    made = lambda x: F.concat(F.lower(F.regexp_extract(x, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit("://"), at(x))
    return F.array_distinct(F.transform(F.filter(links, own), made))


def event_links(x: Column, most: int = 20) -> Column:
    """The first ``most`` distinct event addresses in a text."""
    return F.slice(F.array_distinct(F.regexp_extract_all(x, F.lit("(?i)https?://(?:www\\.|m\\.)?facebook\\.com/events/[^\\s\"'<>]+"), F.lit(0))), 1, most)


def safe_address(url: Column) -> Column:
    """http or https, no credentials, and no literal address of a private, local, link-local or multicast range."""
    at = F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/?#@]+)(?:[/?#]|$)", 1))
    name = F.regexp_replace(at, r":[0-9]+$", "")
    four = r"^(0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\."
    six = r"^\[(::1?\]|f[cd]|fe[89ab]|::ffff:)"
    return (name != "") & (name != "localhost") & ~name.endswith(".localhost") & ~name.rlike(four) & ~name.rlike(six)


def decoded(x: Column) -> Column:
    """Five entities read one after the other."""
    for entity, letter in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        x = F.replace(x, F.lit(entity), F.lit(letter))
    return x


def meta_patterns(name: str) -> list[str]:
    """Patterns of a meta tag's content, in the order in which they are tried."""
    quote = "[\"']"
    content = f"content={quote}([^\"']*){quote}"
    return [f"<meta[^>]+property={quote}{name}{quote}[^>]+{content}", f"<meta[^>]+{content}[^>]+property={quote}{name}{quote}", f"<meta[^>]+name={quote}{name}{quote}[^>]+{content}"]


TITLE = "<title[^>]*>([^<]*)</title>"


def inspected(html: Column) -> tuple[Column, Column]:
    """(title, description) of the first 250000 characters of a page; null where there is none."""
    page = F.substring(html, 1, 250_000)
    found = lambda pattern: F.nullif(F.regexp_extract(page, f"(?i){pattern}", 1), F.lit(""))
    pick = lambda name: F.nullif(trimmed(decoded(F.coalesce(*map(found, meta_patterns(name))))), F.lit(""))
    title = F.nullif(decoded(trimmed(found(TITLE))), F.lit(""))
    return F.coalesce(pick("og:title"), title), F.coalesce(pick("og:description"), pick("description"))
