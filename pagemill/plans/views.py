"""Views over the test tables. One SQL text serves Spark and the checking engine.

``{name}`` stands for a table. Spark fills in a DataFrame, the checker the plain table name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load_table, spread

LF = "chr(10)"
K = "cast(regexp_extract(props, '([0-9]+)', 1) as bigint)"

# Reaction events: 100 messages per 2000 events, four guilds, some direct messages, some bots.
REACTIONS = f"""
SELECT event_id, ts, user_id,
       user_id % 10 = 0 AS user_is_bot,
       (k + 100 * cast(floor(event_id / 2000) as bigint)) * 1000 + k % 3 AS message_id,
       concat('c', cast(k % 4 as varchar(9))) AS channel_id,
       CASE WHEN k % 10 = 9 THEN NULL ELSE concat('g', cast(k % 4 as varchar(9))) END AS guild_id,
       CASE event_type WHEN 'click' THEN '🔖' WHEN 'purchase' THEN '📌' WHEN 'signup' THEN '📝'
                       WHEN 'view' THEN '👍' ELSE '❌' END AS emoji_name,
       CASE WHEN event_type = 'error' THEN concat('e', cast(k % 3 as varchar(9))) END AS emoji_id
FROM (SELECT event_id, ts, user_id, event_type, {K} AS k FROM {{events}}) e
"""

# The channels of the reaction events; one of four is a voice channel.
REACTION_CHANNELS = f"""
SELECT concat('c', cast(c AS varchar(9))) AS channel_id, CASE WHEN c = 3 THEN 'voice' ELSE 'text' END AS type
FROM (SELECT DISTINCT {K} % 4 AS c FROM {{events}}) e
"""

# Settings: stored defaults; a custom emoji id and unset pin emoji; bookmarks off and another pin
# emoji; the fourth guild has no row.
GUILDS = """
SELECT * FROM (VALUES
  ('g0', 1, '🔖', true, '📌', true, 3, 'cat-g0', true),
  ('g1', 1, 'e1', true, cast(NULL as varchar(9)), true, 5, cast(NULL as varchar(9)), true),
  ('g2', 1, '', false, '👍', true, 3, 'cat-g2', false)
) AS t(guild_id, version, bookmark_emoji, bookmark_enabled, pin_emoji, pin_enabled, pin_threshold, channel_category_id, channels_enabled)
"""

# Messages: conversation turns with the address of a page, now and then a second page, a missing
# page, or a denied address.
MESSAGES = """
SELECT c.conv_id * 1000 + c.turn AS message_id,
       CASE WHEN c.conv_id % 5 = 4 THEN NULL ELSE concat('g', cast(c.conv_id % 4 as varchar(9))) END AS guild_id,
       CASE WHEN c.conv_id % 5 = 4 THEN NULL ELSE concat('Guild ', cast(c.conv_id % 4 as varchar(9))) END AS guild_name,
       CASE WHEN c.turn % 4 = 3 THEN NULL ELSE concat('room-', cast(c.conv_id % 12 as varchar(9))) END AS channel_name,
       CASE WHEN c.conv_id % 7 = 6 THEN 'voice' ELSE 'text' END AS channel_type,
       concat('https://chat.example.com/', cast(c.conv_id as varchar(19)), '/', cast(c.turn as varchar(19))) AS url,
       c.role AS username,
       CASE WHEN c.conv_id % 3 = 0 THEN '0' ELSE cast(1000 + c.conv_id as varchar(19)) END AS discriminator,
       c.role = 'assistant' AS author_is_self,
       CASE WHEN c.conv_id % 11 = 10 THEN '' ELSE concat(c.text, ' see ', p.url,
         CASE WHEN c.turn % 2 = 1 THEN concat(' and https://YouTu.be/v', cast(c.conv_id as varchar(19))) ELSE '' END,
         CASE WHEN c.turn % 3 = 1 THEN concat(' or ', q.url, ' ') ELSE '' END,
         CASE WHEN c.turn % 4 = 2 THEN concat(' not https://www.missing.example.org/p', cast(c.conv_id as varchar(19)), '.') ELSE '' END) END AS content
FROM (SELECT conv_id, turn, role, text,
             (conv_id * 7 + turn) % (SELECT count(*) FROM {pages}) AS p1,
             (conv_id * 11 + turn * 3 + 1) % (SELECT count(*) FROM {pages}) AS p2
      FROM {conversations}) c
JOIN (SELECT page_id, url FROM {pages}) p ON p.page_id = c.p1
JOIN (SELECT page_id, url FROM {pages}) q ON q.page_id = c.p2
"""

# Markdown documents: prose with headings, images, fenced code of many sizes, links, front matter.
MARKDOWN = f"""
SELECT doc_id,
       concat('https://', source, '.example.com/docs/cur/page', cast(doc_id as varchar(19)), '.md') AS url,
       concat(
         CASE WHEN doc_id % 6 = 0 THEN concat('---', {LF}, 'title: doc ', cast(doc_id as varchar(19)), {LF}, '---', {LF}) ELSE '' END,
         '# Document ', cast(doc_id as varchar(19)), {LF}, {LF},
         replace(text, {LF}, concat({LF}, {LF})),
         CASE WHEN doc_id % 5 = 0 THEN concat({LF}, {LF}, 'See [other](./other-', cast(doc_id as varchar(19)), '.md), [top](/top?q=1), [up](../../up/./x/../y),',
           ' [far](../../../../z/), [part](#s), [query](?a=1), [abs](http://x.example.org/a), [pr](//cdn.example.org/b), [mail](mailto:a@example.org).') ELSE '' END,
         CASE WHEN doc_id % 3 = 0 THEN concat({LF}, {LF}, '![Figure ', cast(doc_id as varchar(19)), '](images/', cast(doc_id as varchar(19)), '.png)', {LF}, {LF}, 'After the figure.') ELSE '' END,
         CASE WHEN doc_id % 9 = 0 THEN concat('![](plain.png)', {LF}, 'No caption.') ELSE '' END,
         CASE WHEN doc_id % 4 = 0 THEN concat({LF}, {LF}, '## Code   ', {LF}, {LF}, {LF}, {LF}, '```python', {LF},
           repeat(concat('print("line ', cast(doc_id as varchar(19)), '")', {LF}, CASE WHEN doc_id % 8 = 0 THEN {LF} ELSE '' END), cast(doc_id % 201 as int)), '```', {LF}, 'Tail.') ELSE '' END,
         CASE WHEN doc_id % 7 = 0 THEN concat({LF}, {LF}, '* * *', {LF}, {LF}, {LF}, '- item  ', {LF}, '1. first', {LF}, '> quote', {LF}, '| a | b |', {LF}, '---', {LF}, 'plain', {LF}, '```', {LF}, 'open') ELSE '' END
       ) AS text
FROM {{documents}}
"""

# Interactions: commands (one of them unknown) and buttons; arguments come from part names.
INTERACTIONS = f"""
SELECT e.event_id, e.ts, e.user_id,
       CASE WHEN event_type = 'error' THEN 'button' ELSE 'command' END AS kind,
       CASE event_type WHEN 'click' THEN 'join' WHEN 'view' THEN 'ping' WHEN 'signup' THEN 'flush' WHEN 'purchase' THEN 'leave'
            ELSE CASE WHEN k % 5 = 0 THEN 'other' ELSE 'deleteMessage' END END AS name,
       CASE WHEN k % 10 = 9 THEN NULL ELSE concat('g', cast(k % 4 as varchar(9))) END AS guild_id,
       CASE WHEN e.event_id % 3 = 0 THEN p.p_type ELSE p.p_name END AS arg,
       CASE WHEN event_type = 'error' THEN (e.event_id % 200) * 1000 + k % 4 END AS message_id
FROM (SELECT event_id, ts, user_id, event_type, {K} AS k, event_id % (SELECT count(*) FROM {{part}}) AS pk FROM {{events}}) e
JOIN {{part}} p ON p.p_partkey = e.pk
"""

# What users have typed of a channel's name so far: nothing yet, some letters, all of it, or in the wrong case.
TYPED = f"""
SELECT e.event_id, CASE WHEN k % 10 = 9 THEN NULL ELSE concat('g', cast(k % 4 as varchar(9))) END AS guild_id,
       CASE WHEN e.event_id % 9 = 0 THEN p.p_type ELSE left(lower(p.p_type), cast(e.event_id % 7 as int)) END AS typed
FROM (SELECT event_id, event_type, {K} AS k, event_id % (SELECT count(*) FROM {{part}}) AS pk FROM {{events}}) e
JOIN {{part}} p ON p.p_partkey = e.pk
"""

# Settings as two versions of the job have stored them, the older one without pins and channels.
OLD_SETTINGS = """
SELECT DISTINCT concat('u', cast(user_id as varchar(19))) AS guild_id, 1 AS version,
       CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'e1' ELSE '🔖' END AS bookmark_emoji, user_id % 5 <> 0 AS bookmark_enabled
FROM {events} WHERE user_id % 3 = 0
"""
NEW_SETTINGS = """
SELECT DISTINCT concat('u', cast(user_id as varchar(19))) AS guild_id, 2 AS version, '🔖' AS bookmark_emoji, true AS bookmark_enabled,
       CASE user_id % 4 WHEN 0 THEN NULL ELSE '👍' END AS pin_emoji, user_id % 2 = 0 AS pin_enabled, cast(user_id % 7 as int) AS pin_threshold,
       CASE user_id % 5 WHEN 0 THEN concat('cat-', cast(user_id as varchar(19))) END AS channel_category_id, user_id % 5 = 0 AS channels_enabled
FROM {events} WHERE user_id % 3 <> 0
"""

# Channels that exist before any request.
CHANNELS = """
SELECT DISTINCT concat('g', cast(p_size % 4 as varchar(9))) AS guild_id,
       CASE WHEN p_size % 4 = 1 THEN NULL ELSE concat('cat-g', cast(p_size % 4 as varchar(9))) END AS category_id,
       lower(p_type) AS name,
       CASE WHEN p_size % 7 = 0 THEN 'voice' ELSE 'text' END AS type
FROM {part}
WHERE p_type <> 'SMALL'
"""

# Pages with code: the article's text inside the code markups of different site generators.
CODE_PAGES = f"""
SELECT page_id, url, concat(
  '<html><head><title>Code ', cast(page_id as varchar(19)), '</title></head><body><article><h1>Code</h1>',
  CASE page_id % 6
    WHEN 0 THEN concat('<pre><code class="language-sql">', body, '</code></pre>')
    WHEN 1 THEN concat('<pre class="python">', body, '</pre>')
    WHEN 2 THEN concat('<pre><code data-lang="rust">', body, '</code></pre><p>use <code>x</code></p>')
    WHEN 3 THEN concat('<pre>', body, '</pre>')
    WHEN 4 THEN concat('<pre class="hljs-css"><code>', body, '</code></pre>')
    ELSE concat('<pre><code>import os', {LF}, body, '</code></pre>') END,
  '</article></body></html>') AS html
FROM (SELECT page_id, url, concat('x = &quot;', regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&quot;;', {LF}, 'y &lt; 1') AS body FROM {{pages}}) b
"""

# Pages with every code markup there is, inline code included; the page's heading is the code.
CODE_MARKUPS = f"""
SELECT page_id, url, concat(
  '<html><head><title>Markups</title></head><body><article><h1>Code</h1><p>Call <code>', body, '</code> or <code>y &lt; 1</code> here.</p>',
  '<div class="expressive-code"><pre data-language="ts"><div class="ec-line"><div class="code">', body, '</div></div><div class="ec-line"><div class="gutter"></div></div>',
  '<div class="ec-line"><div class="code">end();</div></div></pre></div>',
  '<div class="expressive-code"><pre><code>', body, '</code></pre></div>',
  '<div class="codeBlockContainer_ZGJx language-jsx"><pre class="prism-code language-js"><code><span class="token-line">', body,
  '</span><span class="token-line">end();</span></code></pre></div>',
  '<div class="codeBlockContainer_ZGJx"><pre class="prism-code"><code>', body, '</code></pre></div>',
  '<pre class="astro-code" data-language="go"><code><span class="line">', body, '</span><span class="line">y&nbsp;z</span></code></pre>',
  '<pre class="astro-code language-zig"><code>', body, '</code></pre>',
  '<pre><code class="brush:php">', body, '</code></pre><pre><code class="syntax-lua">', body, '</code></pre>',
  '<pre class="language-perl"><code>', body, '</code></pre><pre class="hljs-xml"><code>', body, '</code></pre>',
  '<pre data-language="yaml"><code>', body, '</code></pre><pre><code>from a import b', {LF}, body, '</code></pre>',
  '<pre class="hljs hljs-ini">', body, '</pre></article></body></html>') AS html
FROM (SELECT page_id, url, concat('x = &quot;', page_id, ' &amp; ', translate(url, ':/.?=&#_', ''), '&quot;;') AS body FROM {{pages}}) b
"""

# Files and portraits of the messages' authors.
MEDIA = """
SELECT conv_id * 1000 + turn AS message_id,
       CASE WHEN conv_id % 4 <> 0 THEN concat('https://cdn.example.com/avatars/', role, '/', cast(conv_id as varchar(19)), '.webp') END AS avatar_url,
       turn % 3 AS n_files, concat('https://cdn.example.com/files/', cast(conv_id as varchar(19)), '/', cast(turn as varchar(19))) AS file_url,
       cast(length(text) * 20000 as bigint) AS file_size
FROM {conversations}
"""

# Snippets: the first sentence of a document behind the opening words of some language.
SNIPPETS = f"""
SELECT doc_id, concat(
  CASE doc_id % 20
    WHEN 0 THEN '#!/bin/bash' WHEN 1 THEN '#!/usr/bin/env  python3' WHEN 2 THEN 'import x from "y"' WHEN 3 THEN 'const f = (a)'
    WHEN 4 THEN '  def f (x)' WHEN 5 THEN 'import java.util' WHEN 6 THEN 'from a import b' WHEN 7 THEN '#include <a.h>'
    WHEN 8 THEN 'using namespace std;' WHEN 9 THEN 'public class A' WHEN 10 THEN 'package main' WHEN 11 THEN '<?php' WHEN 12 THEN '<html lang="x">'
    WHEN 13 THEN '.cls {{{{' WHEN 14 THEN 'select a from' WHEN 15 THEN 'fn main(' WHEN 16 THEN 'use a::' WHEN 17 THEN 'import (' WHEN 18 THEN 'body{{{{' ELSE '' END,
  {LF}, text) AS code
FROM {{documents}}
"""

# Pages with metadata in the head and the content in one of several containers.
META_PAGES = """
SELECT page_id, url,
  replace(replace(replace(html, '<meta charset="utf-8">', concat('<meta charset="utf-8">',
    CASE WHEN page_id % 5 < 2 THEN concat('<meta name="author" content="Writer ', cast(page_id as varchar(19)), '">') ELSE '' END,
    CASE WHEN page_id % 3 = 0 THEN concat('<meta property="article:published_time" content="2024-03-', cast(10 + page_id % 20 as varchar(9)), 'T10:00:00Z">') ELSE '' END,
    CASE WHEN page_id % 3 = 1 THEN '<meta name="date" content="some day">' ELSE '' END,
    CASE WHEN page_id % 4 = 0 THEN '<meta property="og:description" content=" Short &amp; plain ">' ELSE '' END,
    CASE WHEN page_id % 7 = 0 THEN '<meta property="og:site_name" content="The Site">' WHEN page_id % 7 = 1 THEN '<meta property="og:title" content="The Title">' ELSE '' END)),
    '<article>', CASE page_id % 4 WHEN 0 THEN '<article><span class="byline"> By line </span>' WHEN 1 THEN '<main>' WHEN 2 THEN '<div class="post content">' ELSE '<div id="content">' END),
    '</article>', CASE page_id % 4 WHEN 0 THEN '</article>' WHEN 1 THEN '</main>' ELSE '</div>' END) AS html
FROM {pages}
"""

TABLES = ["events", "conversations", "pages", "documents", "part"]


def checker_sql(view: str) -> str:
    """The view as the checking engine reads it."""
    return view.format_map({t: t for t in TABLES}).strip()


def spark_view(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    used = {t: load_table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in view}
    return spark.sql(view, **used)


def spread_view(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view whose rows carry whole texts, one partition per core while the input is small."""
    used = {t: spread(load_table(spark, sf_dir, t)) for t in TABLES if "{" + t + "}" in view}
    return spark.sql(view, **used)


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, REACTIONS)


def reaction_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, REACTION_CHANNELS)


def guilds(spark: SparkSession) -> DataFrame:
    return spark.sql(GUILDS)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, MESSAGES)


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_view(spark, sf_dir, MARKDOWN)


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, INTERACTIONS)


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, CHANNELS)


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, TYPED)


def code_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_view(spark, sf_dir, CODE_PAGES)


def code_markups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_view(spark, sf_dir, CODE_MARKUPS)


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(message_id, avatar_url, attachments)``."""
    rows = spark_view(spark, sf_dir, MEDIA)
    files = "transform(slice(array(1, 2), 1, cast(n_files as int)), i -> struct(concat(file_url, '-', i) AS url, file_size * i AS size))"
    return rows.selectExpr("message_id", "avatar_url", f"{files} AS attachments")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_view(spark, sf_dir, SNIPPETS)


def meta_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_view(spark, sf_dir, META_PAGES)
