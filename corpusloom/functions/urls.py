"""URL keys and canonical URLs as columns; nothing is looked up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that name a campaign or referrer and not the item.
TRACKING = (
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "utm_name",
    "utm_id",
    "fbclid",
    "gclid",
    "dclid",
    "msclkid",
    "igshid",
    "mc_cid",
    "mc_eid",
    "ref",
    "ref_src",
    "ref_url",
    "referrer",
    "source",
    "share_id",
    "usp",
    "sca_esv",
    "_branch_match_id",
)
# Hosts that stand for one site.
VIDEO_HOSTS = ("m.youtube.com", "music.youtube.com", "www.youtube.com", "youtube.com")
FORUM_HOSTS = ("old.reddit.com", "m.reddit.com", "np.reddit.com", "www.reddit.com", "reddit.com")
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def parts(url: Column) -> tuple[Column, Column, Column, Column]:
    """Scheme, host, path and query; empty where there is none."""
    u = F.regexp_replace(F.trim(url), r"[\t\r\n]", "")
    return F.lower(F.regexp_extract(u, _URL, 1)), F.lower(F.regexp_extract(u, _URL, 2)), F.regexp_extract(u, _URL, 3), F.regexp_extract(u, _URL, 4)


def _decoded(text: Column) -> Column:
    """Percent signs that lead no byte stand for themselves."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def kept_query(query: Column, any_utm: bool = False, more: Column | None = None) -> Column:
    """Decoded pairs that are no tracking, sorted and encoded again. ``any_utm``: every utm_ name and nameless pairs go."""
    raw = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(raw, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), _decoded(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))
    pairs = pairs if more is None else F.concat(more, pairs)
    name = lambda p: F.lower(p["k"])
    good = F.filter(pairs, lambda p: ~name(p).isin(*TRACKING) & ((p["k"] != "") & ~F.startswith(name(p), F.lit("utm_")) if any_utm else F.lit(True)))
    return F.array_join(F.transform(F.array_sort(good), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def _built(scheme: Column, host: Column, path: Column, query: Column) -> Column:
    short = F.when((F.length(path) > 1) & F.endswith(path, F.lit("/")), F.regexp_replace(path, "/+$", "")).otherwise(path)
    rooted = F.when((short != "") & ~F.startswith(short, F.lit("/")), F.concat(F.lit("/"), short)).otherwise(short)
    bare = F.when(F.startswith(short, F.lit("//")) | (scheme.isin("http", "https", "ftp") & ((short == "") | F.startswith(short, F.lit("/")))), F.concat(F.lit("//"), short)).otherwise(short)
    head = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise("")
    return F.concat(head, F.when(host != "", F.concat(F.lit("//"), host, rooted)).otherwise(bare), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def url_key(url: Column) -> Column:
    """Light key: lower-case scheme and host, no fragment, no tracking, sorted query, no slash at the end. A missing scheme stays so."""
    scheme, host, path, query = parts(url)
    return _built(scheme, host, path, kept_query(query))


def canonical_url(url: Column) -> Column:
    """One form per item: also share links and mobile hosts folded, ``www.`` and every ``utm_*`` dropped."""
    scheme, host, path, query = parts(url)
    bare = F.when(F.startswith(host, F.lit("www.")), F.substring(host, 5, 1000)).otherwise(host)
    share, shorts = bare == "youtu.be", bare.isin(*VIDEO_HOSTS) & F.startswith(path, F.lit("/shorts/"))
    inner = F.regexp_replace(path, "^/+|/+$", "")
    video = F.when(share, inner).when(shorts, F.when(F.contains(inner, F.lit("/")), F.regexp_replace(inner, "^[^/]*/", "")).otherwise(inner))
    none = F.array().cast("array<struct<k:string,v:string>>")
    more = F.when(video.isNotNull(), F.array(F.struct(F.lit("v").alias("k"), video.alias("v")))).otherwise(none)
    site = F.when(share | bare.isin(*VIDEO_HOSTS), "youtube.com").when(bare.isin(*FORUM_HOSTS), "reddit.com").otherwise(bare)
    return _built(F.when(scheme == "", "https").otherwise(scheme), site, F.when(video.isNotNull(), "/watch").otherwise(path), kept_query(query, True, more))


def video_id(url: Column) -> Column:
    """Id of a video from its watch, short or share form; null if there is none."""
    found = [F.regexp_extract(url, p, 1) for p in (r"[?&]v=([A-Za-z0-9_\-]{6,})", r"youtu\.be/([A-Za-z0-9_\-]{6,})", r"/shorts/([A-Za-z0-9_\-]{6,})")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def thread_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/comments/([A-Za-z0-9]+)", 1), F.lit(""))


def is_forum_link(url: Column) -> Column:
    host = parts(url)[1]
    return host.isin(*FORUM_HOSTS) | F.endswith(host, F.lit(".reddit.com"))
