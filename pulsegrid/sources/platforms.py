"""Raw JSON payloads of five platforms to one form of post; a projection for each, no rows are touched in Python.

A payload without an id gives no post. A time that can't be read is null (``ts``), so that it can be set aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hashtags, mentions, urls
from .shared import cut


def _at(path: str) -> Column:
    return F.get_json_object("payload", f"$.{path}")


def _filled(*choices: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in choices])


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def parsed_time(c: Column) -> Column:
    """ISO text or seconds since the epoch."""
    seconds = c.try_cast("double")
    return F.coalesce(F.when(seconds.isNotNull(), F.timestamp_micros((seconds * 1000000).cast("bigint"))), F.try_to_timestamp(c))


def _post(payloads: DataFrame, platform: str, id: Column, author: Column, name: Column, text: Column, time: Column, parent: Column, client: Column, links: Column, tags: Column, users: Column, likes, reposts, replies, views, shares, reply_to: Column | None = None, more: Column | None = None) -> DataFrame:
    ts = parsed_time(time)
    none = F.lit(None).cast("string")
    out = payloads.select(
        id.alias("id"), F.lit(platform).alias("platform"), F.coalesce(author, F.lit("unknown")).alias("author_id"), name.alias("author_screen_name"), F.coalesce(text, F.lit("")).alias("text"), ts.alias("ts"), F.unix_millis(ts).alias("timestamp_ms"),
        parent.alias("parent_id"), (none if reply_to is None else reply_to).alias("reply_to_user_id"), client.alias("source_client"), links.alias("urls"), tags.alias("hashtags"), users.alias("mentions"),
        F.struct(likes.alias("likes"), reposts.alias("reposts"), replies.alias("replies"), views.alias("views"), shares.alias("shares")).alias("metrics"), (none if more is None else more).alias("extra_metadata"),
    )
    return out.filter("id is not null and id != ''")


def _listed(path: str, field: str, otherwise: Column) -> Column:
    items = F.from_json(_at(path), f"array<struct<{field}:string,url:string>>")
    return F.when(_at(path).isNotNull(), F.transform(items, lambda x: F.coalesce(x[field], x["url"], F.lit("")))).otherwise(otherwise)


def twitter(payloads: DataFrame) -> DataFrame:
    text = _at("text")
    count = lambda k: _number(_at(f"public_metrics.{k}"))
    views = F.when(_at("public_metrics.impression_count").isNotNull(), count("impression_count"))
    return _post(payloads, "twitter", _at("id"), _at("author_id"), _filled(_at("author_screen_name"), _at("username")), text, _at("created_at"), _at("referenced_tweets[0].id"), _at("source"), _listed("entities.urls", "expanded_url", urls(text)), _listed("entities.hashtags", "tag", hashtags(text)), _listed("entities.mentions", "username", mentions(text)), count("like_count"), count("retweet_count"), count("reply_count"), views, count("quote_count"), _filled(_at("in_reply_to_user_id")), F.to_json(F.struct(_at("conversation_id").alias("conversation_id"), _at("lang").alias("lang"))))


def reddit(payloads: DataFrame) -> DataFrame:
    title, body = _filled(F.trim(_at("title"))), _filled(F.trim(_at("selftext")), F.trim(_at("body")))
    text = F.coalesce(F.when(title.isNotNull() & body.isNotNull(), F.concat(title, F.lit("\n\n"), body)), title, body, F.lit(""))
    link = F.when(_filled(_at("permalink")).isNotNull(), F.array(F.concat(F.lit("https://reddit.com"), _at("permalink")))).otherwise(F.array().cast("array<string>"))
    zero = F.lit(0).cast("bigint")
    up = lambda c: F.greatest(zero, _number(c))
    return _post(payloads, "reddit", _filled(_at("id"), _at("name")), _filled(_at("author_fullname"), _at("author")), F.coalesce(_filled(_at("author")), F.lit("anonymous")), text, _at("created_utc"), _filled(_at("parent_id")), F.lit("Reddit API"), F.array_union(urls(text), link), hashtags(text), mentions(text), up(_at("score")), zero, up(_at("num_comments")), F.when(_number(_at("view_count")) > 0, _number(_at("view_count"))), zero, more=F.to_json(F.struct(_at("subreddit").alias("subreddit"))))


def youtube(payloads: DataFrame) -> DataFrame:
    at = lambda k: F.coalesce(_at(f"snippet.topLevelComment.snippet.{k}"), _at(f"snippet.{k}"))
    text = F.coalesce(_filled(at("textOriginal"), at("textDisplay"), _at("text")), F.lit(""))
    video = _filled(_at("snippet.videoId"), _at("video_id"))
    zero = F.lit(0).cast("bigint")
    link = F.when(video.isNotNull(), F.array(F.concat(F.lit("https://www.youtube.com/watch?v="), video))).otherwise(F.array().cast("array<string>"))
    parent = F.coalesce(_filled(at("parentId")), F.concat(F.lit("video_"), video))
    return _post(payloads, "youtube", _at("id"), _filled(at("authorChannelId.value"), at("authorChannelId"), _at("author_id")), F.coalesce(_filled(at("authorDisplayName"), _at("author_screen_name")), F.lit("YouTubeUser")), text, F.coalesce(at("publishedAt"), _at("timestamp")), parent, F.lit("YouTube Data API v3"), F.concat(urls(text), link), hashtags(text), mentions(text), _number(at("likeCount")), zero, _number(_at("snippet.totalReplyCount")), F.lit(None).cast("bigint"), zero, more=F.to_json(F.struct(video.alias("video_id"))))


def telegram(payloads: DataFrame) -> DataFrame:
    text = F.coalesce(_filled(_at("text"), _at("message"), _at("caption")), F.lit(""))
    chat, message, channel = F.coalesce(_at("chat.id"), _at("chat_id")), F.coalesce(_at("message_id"), _at("id")), _filled(_at("chat.username"))
    name = lambda m: F.concat(F.lit("tg_"), chat, F.lit("_"), m)
    link = F.when(channel.isNotNull(), F.array(F.concat(F.lit("https://t.me/"), channel, F.lit("/"), message))).otherwise(F.array().cast("array<string>"))
    screen = F.coalesce(_filled(_at("author_signature"), _at("from.username"), _at("from.first_name"), channel, _at("chat.title")), F.lit("TelegramChannel"))
    views = F.when(_at("views").isNotNull(), _number(_at("views")))
    return _post(payloads, "telegram", name(message), _filled(_at("from.id"), chat), screen, text, _at("date"), name(_at("reply_to_message.message_id")), F.lit("Telegram MTProto/Bot API"), F.concat(urls(text), link), hashtags(text), mentions(text), _number(_at("likes")), _number(_at("forwards")), _number(_at("replies")), views, _number(_at("forwards")), more=F.to_json(F.struct(chat.alias("chat_id"), _at("chat.title").alias("chat_title"))))


def bluesky(payloads: DataFrame) -> DataFrame:
    key = lambda uri: F.when(F.contains(uri, F.lit("/app.bsky.feed.post/")), F.element_at(F.split(uri, "/app.bsky.feed.post/"), -1))
    text = F.coalesce(_filled(_at("record.text"), _at("text")), F.lit(""))
    parent = F.coalesce(_at("record.reply.parent.uri"), _at("reply.parent.uri"))
    return _post(payloads, "bluesky", _filled(key(_at("uri")), _at("cid"), _at("id")), F.coalesce(_filled(_at("author.did"), _at("author_id")), F.lit("unknown_bsky")), _filled(_at("author.handle"), _at("author_screen_name")), text, F.coalesce(_at("record.createdAt"), _at("created_at")), _filled(key(parent), parent, _at("parent_id")), F.lit("AT Protocol"), urls(text), hashtags(text), mentions(text), _number(_at("likeCount")), _number(_at("repostCount")), _number(_at("replyCount")), F.lit(None).cast("bigint"), _number(_at("quoteCount")))


NORMALISERS = {"twitter": twitter, "reddit": reddit, "youtube": youtube, "telegram": telegram, "bluesky": bluesky}


def thread_posts(payloads: DataFrame, most_depth: int = 50) -> DataFrame:
    """(depth, payload) of every post in nested thread views (post, replies), level by level.

    Each level's replies are written out, so what lies above is parsed once."""
    level = payloads.select(F.lit(0).alias("depth"), "payload")
    out = None
    for d in range(most_depth + 1):
        here = level.select("depth", F.get_json_object("payload", "$.post").alias("payload")).filter("payload is not null")
        out = here if out is None else out.union(here)
        kids = F.variant_get(F.try_parse_json(F.col("payload")), "$.replies", "array<variant>")
        level = cut(level.select(F.lit(d + 1).alias("depth"), F.explode(F.transform(kids, lambda v: F.to_json(v))).alias("payload")))
        if level.isEmpty():
            break
    return out
