"""URL expressions: extraction, filtering, host names and relative resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import indices, let, pick
from .text import WS, WS_CHARS

URL_PATTERN = rf"(https?://[^{WS}]+)"
MARKDOWN_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
BASE_PATTERN = r"\A([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"
SCHEME_PATTERN = r"\A[A-Za-z][A-Za-z0-9+.\-]*:"

# Places and file types that hold no article.
DENIED_PLACES = [
    "discord.com",
    "discordapp.com",
    "youtube.com/watch",
    "youtu.be",
    "twitter.com",
    "x.com",
    "instagram.com",
    "tiktok.com",
    "facebook.com",
    "reddit.com",
]
DENIED_SUFFIXES = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".mp4", ".webm"]


def extract_urls(text: Column) -> Column:
    """All http(s) URLs in order; duplicates and trailing punctuation are kept."""
    return F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(1))


def is_content_url(url: Column, match: str = "substring") -> Column:
    """True unless the URL points at a denied place or a media file.

    ``match="substring"`` looks for the place anywhere in the URL, ``match="host"`` demands that
    the host is the denied one or a subdomain of it.
    """
    lowered = F.lower(url)
    places = "|".join(place.replace(".", r"\.") for place in DENIED_PLACES)
    if match == "host":
        places = rf"\Ahttps?://(?:[^/?#]*@)?(?:[^/?#]*\.)?(?:{places})(?![A-Za-z0-9.\-])"
    suffixes = "|".join(suffix[1:] for suffix in DENIED_SUFFIXES)
    return ~lowered.rlike(places) & ~lowered.rlike(rf"\.(?:{suffixes})\z")


def content_urls(text: Column, match: str = "substring") -> Column:
    return F.filter(extract_urls(text), lambda u: is_content_url(u, match))


def fetch_key(url: Column) -> Column:
    """What a request for the URL asks for: the URL without its fragment."""
    return F.regexp_replace(url, "#.*$", "")


def host_name(url: Column) -> Column:
    authority = F.regexp_extract(url, BASE_PATTERN, 2)
    host = F.regexp_replace(F.regexp_replace(authority, r"\A.*@", ""), r":[0-9]*\z", "")
    return F.lower(F.nullif(host, F.lit("")))


def site_of(url: Column) -> Column:
    """Host name without its first ``www.``."""
    return F.regexp_replace(host_name(url), r"\A(.*?)www\.", "$1")


def base_parts(base: Column) -> Column:
    """scheme, authority (no user info, no default port), path and href; NULL for a bad base."""
    scheme = F.lower(F.regexp_extract(base, BASE_PATTERN, 1))
    authority = F.lower(F.regexp_replace(F.regexp_extract(base, BASE_PATTERN, 2), r"\A.*@", ""))
    default_port = F.when(scheme == "http", ":80").when(scheme == "https", ":443").otherwise(":")
    host = F.when(F.endswith(authority, default_port), F.regexp_replace(authority, r":[0-9]*\z", "")).otherwise(authority)
    path = F.regexp_extract(base, BASE_PATTERN, 3)
    rest = F.regexp_extract(base, r"\A[^?#]*([?#](?s:.*))?\z", 1)
    full_path = F.when(path == "", "/").otherwise(path)
    return F.when(
        base.rlike(BASE_PATTERN) & (host != ""),
        F.struct(
            scheme.alias("scheme"),
            host.alias("host"),
            full_path.alias("path"),
            F.concat(scheme, F.lit("://"), host, full_path, F.coalesce(rest, F.lit(""))).alias("href"),
        ),
    )


def resolve_path(base_path: Column, relative: Column) -> Column:
    """Directory plus relative path with ``..`` popped (clamped at the root) and ``.`` dropped."""
    empty = F.array().cast("array<string>")
    steps = F.split(F.concat(base_path, F.lit("/"), relative), "/", -1)
    walked = F.aggregate(
        F.filter(steps, lambda s: (s != "") & (s != ".")),
        empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)),
    )
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def resolve_url(url: Column, base: Column) -> Column:
    """Resolve one link against ``base_parts``."""
    directory = F.regexp_extract(base["path"], r"\A(.*/)", 1)
    return (
        F.when(F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://")), url)
        .when(F.startswith(url, F.lit("//")), F.concat(base["scheme"], F.lit(":"), url))
        .when(F.startswith(url, F.lit("/")), F.concat(base["scheme"], F.lit("://"), base["host"], url))
        .when(F.startswith(url, F.lit("#")) | F.startswith(url, F.lit("?")), F.concat(base["href"], url))
        .when(url.rlike(SCHEME_PATTERN), url)
        .otherwise(F.concat(base["scheme"], F.lit("://"), base["host"], resolve_path(directory, url)))
    )


def absolutize_markdown(text: Column, base_url: Column) -> Column:
    """Resolve every Markdown link of a text against the URL it came from."""

    def rebuild(b: Column) -> Column:
        def piece(i: Column) -> Column:
            link = pick(b["links"], i)
            label = F.regexp_extract(link, rf"\A{MARKDOWN_LINK}\z", 1)
            target = F.regexp_extract(link, rf"\A{MARKDOWN_LINK}\z", 2)
            whole = F.concat(F.lit("["), label, F.lit("]("), resolve_url(target, b["base"]), F.lit(")"))
            return F.concat(pick(b["parts"], i), F.coalesce(whole, link, F.lit("")))

        return F.array_join(F.transform(indices(b["parts"]), piece), "")

    resolved = let(
        rebuild,
        parts=F.split(text, MARKDOWN_LINK, -1),
        links=F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(0)),
        base=base_parts(base_url),
    )
    return F.when(F.contains(text, F.lit("](")) & base_url.rlike(BASE_PATTERN), F.coalesce(resolved, text)).otherwise(text)


__all__ = ["WS_CHARS", "absolutize_markdown", "base_parts", "content_urls", "extract_urls", "fetch_key", "host_name", "is_content_url", "resolve_path", "resolve_url", "site_of"]
