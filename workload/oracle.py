"""The same queries in SQL, written apart from the operators, over the same tables."""

from __future__ import annotations

from itertools import combinations

COLUMNS = (
    "post_length_band", "time_of_day", "weekday_name", "source_group", "follower_band",
    "author_activity_band", "has_image", "has_video", "is_weekend",
)
FLAGS = ("has_image", "has_video", "is_weekend")
TARGETS = ("high_engagement", "high_reach_adjusted_engagement")
QUANTILE = "0.9"
IN_STUDY = "{0} IS NOT NULL AND {0} >= TIMESTAMP '1996-01-01' AND {0} < TIMESTAMP '2001-01-01'"

# Raw lines.

LINES = r"""
lines AS (
    SELECT
        CASE
            WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
                THEN o_orderkey || chr(9) || o_orderstatus
            WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH'
                THEN whole || chr(9) || 'extra'
            WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN ''
            WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED'
                THEN repeat(chr(9), 4)
            WHEN o_orderstatus = 'P'
                THEN concat_ws(chr(9), o_orderkey::VARCHAR, '\N', 'null', 'NULL', ' null ')
            ELSE whole
        END AS value,
        o_orderstatus || '.csv' AS source_file,
        floor(o_orderkey / 50000)::BIGINT AS part,
        row_number() OVER (PARTITION BY floor(o_orderkey / 50000) ORDER BY o_orderkey) AS line
    FROM (
        SELECT *, concat_ws(
            chr(9), ' ' || chr(160) || o_orderkey || chr(12288) || ' ', o_orderstatus, o_totalprice::VARCHAR,
            o_orderdate::VARCHAR, '"' || o_orderpriority || ' '
        ) AS whole
        FROM orders
    )
),
cut AS (
    SELECT *, string_split(value, chr(9)) AS f FROM lines WHERE value <> ''
),
raw AS (
    SELECT
        CASE WHEN f[1] NOT IN ('', '\N', 'null', 'NULL') THEN f[1] END AS post_id,
        CASE WHEN f[2] NOT IN ('', '\N', 'null', 'NULL') THEN f[2] END AS status,
        CASE WHEN f[3] NOT IN ('', '\N', 'null', 'NULL') THEN f[3] END AS price,
        CASE WHEN f[4] NOT IN ('', '\N', 'null', 'NULL') THEN f[4] END AS posted_at,
        CASE WHEN f[5] NOT IN ('', '\N', 'null', 'NULL') THEN f[5] END AS note,
        source_file
    FROM cut WHERE len(f) = 5
),
rejected AS (
    SELECT
        source_file, value AS raw_line, len(f)::INTEGER AS field_count, 5 AS expected_count,
        CASE WHEN len(f) < 5 THEN 'MISSING COLUMNS' ELSE 'TOO MANY COLUMNS' END AS error_type,
        part, line
    FROM cut WHERE len(f) <> 5
),
clean AS (
    SELECT
        nullif(trim(post_id), '') AS post_id,
        nullif(trim(status), '') AS status,
        try_cast(price AS DOUBLE) AS price,
        try_cast(posted_at AS TIMESTAMP) AS posted_at,
        posted_at AS posted_at_raw,
        note,
        source_file
    FROM raw
),
flagged AS (
    SELECT
        post_id,
        post_id IS NOT NULL AND status IS NOT NULL AS identifier_is_valid,
        posted_at IS NOT NULL AND posted_at >= TIMESTAMP '1996-01-01'
            AND posted_at < TIMESTAMP '2001-01-01' AS timestamp_in_study_window
    FROM clean
)
"""

MESSY = """
messy AS (
    SELECT
        o_orderkey,
        CASE
            WHEN o_orderpriority = '1-URGENT' THEN o_totalprice || 'd'
            WHEN o_orderpriority = '2-HIGH' THEN ' -' || o_totalprice || ' '
            WHEN o_orderpriority = '3-MEDIUM' THEN o_orderkey || '.5'
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_totalprice || 'e9'
            WHEN o_orderstatus = 'F' THEN 'abc'
            WHEN o_orderstatus = 'P' THEN '1e3'
            ELSE o_totalprice::VARCHAR
        END AS number,
        CASE
            WHEN o_orderpriority = '1-URGENT' THEN substr(o_orderdate::VARCHAR, 1, 7)
            WHEN o_orderpriority = '2-HIGH' THEN substr(o_orderdate::VARCHAR, 1, 10)
            WHEN o_orderpriority = '3-MEDIUM' THEN replace(o_orderdate::VARCHAR, ' ', 'T')
            WHEN o_orderpriority = '4-NOT SPECIFIED'
                THEN substr(o_orderdate::VARCHAR, 1, 5) || '13-01'
            WHEN o_orderstatus = 'F' THEN ' ' || o_orderdate
            WHEN o_orderstatus = 'P' THEN substr(o_orderdate::VARCHAR, 1, 13)
            ELSE o_orderdate || '.25'
        END AS time
    FROM orders
)
"""

# The tables in their roles.

ENTRIES = f"""
posts_file AS (
    SELECT
        o_orderkey AS post_id,
        o_custkey AS author_id,
        CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderpriority || ' ' || o_orderstatus END
            AS source_name,
        o_orderdate + to_hours((o_orderkey % 24)::INTEGER) AS posted_at,
        CASE WHEN o_orderpriority <> '5-LOW' THEN
            '<b>' || o_orderpriority || '</b> '
            || repeat('#' || o_orderstatus || ' item ', floor(o_totalprice / 20000)::INTEGER)
            || CASE WHEN o_orderstatus = 'F' THEN 'see https://shop/' ELSE '' END
        END AS post_text,
        CASE WHEN o_orderstatus <> 'F' THEN floor(o_totalprice / 100000)::INTEGER END
            AS image_count,
        CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 0 END AS video_count,
        'posts' AS source_file
    FROM orders
),
entries AS (
    SELECT *, {IN_STUDY.format('posted_at')} AS timestamp_in_study_window
    FROM (
        SELECT * FROM posts_file
        UNION ALL
        SELECT * REPLACE (posted_at - INTERVAL 10 DAY AS posted_at, 'copies' AS source_file)
        FROM posts_file WHERE source_name = ' '
    )
    WHERE post_id IS NOT NULL AND author_id IS NOT NULL
),
measured AS (
    SELECT
        *, regexp_replace(coalesce(post_text, ''), '<[^>]+>', ' ', 'g') AS visible
    FROM entries
),
unique_posts AS (
    SELECT
        post_id, author_id, posted_at, source_file, timestamp_in_study_window,
        coalesce(nullif(trim(source_name), ''), 'in house') AS source_name,
        image_count, video_count,
        length(visible) AS character_count,
        len(regexp_extract_all(visible, '[[:alnum:]_]+'))::BIGINT AS word_count,
        len(regexp_extract_all(visible, '#[[:alnum:]_]+'))::BIGINT AS hashtag_count,
        len(regexp_extract_all(visible, 'https?://'))::BIGINT AS url_count
    FROM measured
    QUALIFY row_number() OVER (
        PARTITION BY post_id ORDER BY posted_at NULLS LAST, source_file
    ) = 1
),
comments AS (
    SELECT l_orderkey AS entry_id, l_suppkey AS author_id, l_shipdate AS commented_at
    FROM lineitem WHERE l_returnflag = 'A'
),
likes AS (
    SELECT l_partkey AS user_id, l_orderkey AS post_id, l_shipdate AS liked_at
    FROM lineitem WHERE l_returnflag <> 'A'
),
subscriptions AS (
    SELECT
        l_suppkey AS subscriber_id, CASE WHEN l_linenumber <> 7 THEN l_partkey END AS subscribed_to_id
    FROM lineitem
)
"""

ENGAGEMENT = """
comment_counts AS (
    SELECT
        entry_id AS post_id, count(*) AS recorded,
        count(*) FILTER (
            WHERE commented_at >= posted_at AND commented_at < posted_at + INTERVAL 365 DAY
        ) AS inside
    FROM comments JOIN unique_posts ON entry_id = post_id
    GROUP BY entry_id
),
like_counts AS (
    SELECT
        likes.post_id, count(*) AS recorded,
        count(*) FILTER (
            WHERE liked_at >= posted_at AND liked_at < posted_at + INTERVAL 365 DAY
        ) AS inside
    FROM likes JOIN unique_posts ON likes.post_id = unique_posts.post_id
    GROUP BY likes.post_id
),
engagement AS (
    SELECT
        p.post_id, p.author_id, p.posted_at, p.timestamp_in_study_window,
        p.posted_at IS NOT NULL AND p.posted_at >= TIMESTAMP '1996-01-01'
            AND p.posted_at < TIMESTAMP '2001-01-01' - INTERVAL 365 DAY AS has_full_7d_window,
        coalesce(c.recorded, 0) AS comment_count_recorded,
        coalesce(l.recorded, 0) AS like_count_recorded,
        coalesce(c.inside, 0) AS comment_count_7d,
        coalesce(l.inside, 0) AS like_count_7d,
        coalesce(c.inside, 0) + coalesce(l.inside, 0) AS engagement_count_7d
    FROM unique_posts p
    LEFT JOIN comment_counts c USING (post_id)
    LEFT JOIN like_counts l USING (post_id)
)
"""

AUTHORS = f"""
user_rows AS (
    SELECT
        c_custkey AS user_id, lower(c_mktsegment) AS user_type,
        CASE WHEN c_acctbal < 5000 THEN c_name END AS user_description, 'users' AS source_file
    FROM customer
    UNION ALL
    SELECT c_custkey, 'archived', CASE WHEN c_acctbal < 5000 THEN c_name END, 'archive'
    FROM customer WHERE c_acctbal < 0
),
unique_users AS (
    SELECT * FROM user_rows
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY source_file) = 1
),
activity AS (
    SELECT
        author_id, count(*) AS post_count, min(posted_at) AS first_post_at,
        max(posted_at) AS last_post_at
    FROM unique_posts GROUP BY author_id
),
authors AS (
    SELECT
        a.author_id,
        u.user_type,
        u.user_description IS NOT NULL AS has_profile_description,
        a.post_count, a.first_post_at, a.last_post_at,
        coalesce(c.n, 0) AS comments_written,
        coalesce(l.n, 0) AS likes_given,
        coalesce(s.n, 0) AS connected_service_count,
        f.n AS follower_count,
        g.n AS following_count,
        coalesce(e.n, 0) AS new_follower_count,
        f.n IS NOT NULL AS network_snapshot_available
    FROM activity a
    LEFT JOIN (SELECT author_id, count(*) AS n FROM comments GROUP BY ALL) c USING (author_id)
    LEFT JOIN (SELECT user_id AS author_id, count(*) AS n FROM likes GROUP BY ALL) l
        USING (author_id)
    LEFT JOIN (
        SELECT o_custkey AS author_id, count(DISTINCT o_orderpriority) AS n
        FROM orders GROUP BY ALL
    ) s USING (author_id)
    LEFT JOIN (
        SELECT subscribed_to_id AS author_id, count(DISTINCT subscriber_id) AS n
        FROM subscriptions WHERE subscribed_to_id IS NOT NULL GROUP BY ALL
    ) f USING (author_id)
    LEFT JOIN (
        SELECT subscriber_id AS author_id, count(DISTINCT subscribed_to_id) AS n
        FROM subscriptions WHERE subscribed_to_id IS NOT NULL GROUP BY ALL
    ) g USING (author_id)
    LEFT JOIN (
        SELECT l_partkey AS author_id, count(DISTINCT l_suppkey) AS n
        FROM lineitem WHERE {IN_STUDY.format('l_shipdate')} GROUP BY ALL
    ) e USING (author_id)
    LEFT JOIN unique_users u ON a.author_id = u.user_id
)
"""

FEATURES = """
popular AS (
    SELECT source_name FROM unique_posts GROUP BY source_name
    ORDER BY count(*) DESC, source_name LIMIT 7
),
base AS (
    SELECT
        p.post_id, p.author_id, p.posted_at, p.source_name,
        CASE WHEN p.source_name IN (SELECT source_name FROM popular) THEN p.source_name
            ELSE 'Other' END AS source_group,
        coalesce(p.image_count, 0) AS image_count,
        coalesce(p.video_count, 0) AS video_count,
        p.character_count, p.word_count, p.hashtag_count, p.url_count,
        coalesce(p.image_count, 0) > 0 AS has_image,
        coalesce(p.video_count, 0) > 0 AS has_video,
        hour(p.posted_at)::INTEGER AS post_hour,
        isodow(p.posted_at)::INTEGER AS weekday_number,
        dayname(p.posted_at) AS weekday_name,
        isodow(p.posted_at) IN (6, 7) AS is_weekend,
        a.user_type,
        coalesce(a.has_profile_description, false) AS has_profile_description,
        coalesce(a.post_count, 0) AS author_post_count,
        coalesce(a.comments_written, 0) AS author_comments_written,
        coalesce(a.likes_given, 0) AS author_likes_given,
        coalesce(a.connected_service_count, 0) AS connected_service_count,
        a.follower_count, a.following_count,
        coalesce(a.new_follower_count, 0) AS new_follower_count,
        coalesce(a.network_snapshot_available, false) AS network_snapshot_available,
        e.comment_count_recorded, e.like_count_recorded, e.comment_count_7d, e.like_count_7d,
        e.engagement_count_7d, e.has_full_7d_window,
        CASE WHEN p.character_count = 0 THEN 'empty' WHEN p.character_count < 80 THEN 'short'
            WHEN p.character_count < 200 THEN 'medium' WHEN p.character_count < 500 THEN 'long'
            ELSE 'very_long' END AS post_length_band,
        CASE WHEN hour(p.posted_at) < 6 THEN 'night' WHEN hour(p.posted_at) < 12 THEN 'morning'
            WHEN hour(p.posted_at) < 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day,
        CASE WHEN a.follower_count IS NULL THEN 'unknown' WHEN a.follower_count = 0 THEN '0'
            WHEN a.follower_count < 10 THEN '1-9' WHEN a.follower_count < 100 THEN '10-99'
            WHEN a.follower_count < 1000 THEN '100-999' ELSE '1000+' END AS follower_band,
        CASE WHEN a.post_count < 10 THEN '1-9' WHEN a.post_count < 100 THEN '10-99'
            WHEN a.post_count < 1000 THEN '100-999' ELSE '1000+' END AS author_activity_band,
        e.engagement_count_7d::DOUBLE / (a.follower_count + 1) AS reach_adjusted_engagement,
        p.timestamp_in_study_window AND e.has_full_7d_window AND p.post_id IS NOT NULL
            AND p.author_id IS NOT NULL AS analysis_eligible
    FROM unique_posts p
    JOIN engagement e USING (post_id)
    LEFT JOIN authors a ON p.author_id = a.author_id
)
"""

LABELS = f"""
limits AS (
    SELECT
        greatest(1, coalesce(quantile_disc(engagement_count_7d, {QUANTILE}), 0))::BIGINT
            AS raw_threshold,
        greatest(0.0, coalesce(
            quantile_cont(reach_adjusted_engagement, {QUANTILE})
                FILTER (WHERE reach_adjusted_engagement > 0), 0.0)
        )::DOUBLE AS reach_threshold
    FROM base WHERE analysis_eligible
),
features AS (
    SELECT
        base.*,
        analysis_eligible AND engagement_count_7d > 0 AND engagement_count_7d >= raw_threshold
            AS high_engagement,
        analysis_eligible AND reach_adjusted_engagement IS NOT NULL
            AND reach_adjusted_engagement > 0 AND reach_adjusted_engagement >= reach_threshold
            AS high_reach_adjusted_engagement
    FROM base, limits
),
eligible AS (
    SELECT * FROM features WHERE analysis_eligible
)
"""


def item(column: str) -> str:
    if column in FLAGS:
        value = f"CASE WHEN {column} THEN 'yes' WHEN NOT {column} THEN 'no' ELSE 'missing' END"
    else:
        value = f"coalesce({column}, 'missing')"
    return f"'{column}=' || {value}"


def counted_sets(max_size: int) -> str:
    """Counts of each combination of up to ``max_size`` columns, one GROUP BY per column set."""
    parts = []
    for size in range(1, max_size + 1):
        for chosen in combinations(COLUMNS, size):
            text = " || ' AND ' || ".join(item(column) for column in chosen)
            parts.append(
                f"""
                SELECT
                    {text} AS antecedent,
                    {size} AS antecedent_size,
                    {str('source_group' in chosen).lower()} AS uses_source,
                    count(*) AS antecedent_count,
                    count(DISTINCT author_id) AS antecedent_author_count,
                    count(*) FILTER (WHERE high_engagement) AS joint1,
                    count(DISTINCT author_id) FILTER (WHERE high_engagement) AS authors1,
                    count(*) FILTER (WHERE high_reach_adjusted_engagement) AS joint2,
                    count(DISTINCT author_id) FILTER (WHERE high_reach_adjusted_engagement)
                        AS authors2
                FROM eligible GROUP BY {', '.join(chosen)}
                """
            )
    return " UNION ALL ".join(parts)


RULES = f"""
counted AS ({counted_sets(2)}),
totals AS (
    SELECT
        count(*) AS eligible_posts,
        count(*) FILTER (WHERE high_engagement) AS hits1,
        count(*) FILTER (WHERE high_reach_adjusted_engagement) AS hits2
    FROM eligible
),
by_target AS (
    SELECT
        antecedent, antecedent_size, antecedent_count, antecedent_author_count,
        '{TARGETS[0]}' AS target, joint1 AS joint_count, authors1 AS joint_author_count
    FROM counted
    UNION ALL
    SELECT
        antecedent, antecedent_size, antecedent_count, antecedent_author_count,
        '{TARGETS[1]}', joint2, authors2
    FROM counted
),
candidates AS (
    SELECT
        antecedent, antecedent_size, uses_source, antecedent_count, joint1 AS joint_count,
        joint1::DOUBLE / eligible_posts AS support,
        joint1::DOUBLE / antecedent_count AS confidence,
        (joint1::DOUBLE / antecedent_count) / (hits1::DOUBLE / eligible_posts) AS lift
    FROM counted, totals
    WHERE joint1 >= greatest(1, floor(0.0001::DOUBLE * eligible_posts))
)
"""

MEANINGS = """
meanings(feature, category, definition) AS (VALUES
    ('post_length_band', 'empty', 'No visible text after HTML tags are removed'),
    ('post_length_band', 'short', '1--79 visible characters'),
    ('post_length_band', 'medium', '80--199 visible characters'),
    ('post_length_band', 'long', '200--499 visible characters'),
    ('post_length_band', 'very_long', 'At least 500 visible characters'),
    ('time_of_day', 'night', '00:00--05:59 (GMT+1)'),
    ('time_of_day', 'morning', '06:00--11:59 (GMT+1)'),
    ('time_of_day', 'afternoon', '12:00--17:59 (GMT+1)'),
    ('time_of_day', 'evening', '18:00--23:59 (GMT+1)'),
    ('follower_band', 'unknown', 'Follower count unavailable in the network snapshot'),
    ('follower_band', '0', 'No recorded followers'),
    ('follower_band', '1-9', '1--9 recorded followers'),
    ('follower_band', '10-99', '10--99 recorded followers'),
    ('follower_band', '100-999', '100--999 recorded followers'),
    ('follower_band', '1000+', 'At least 1,000 recorded followers'),
    ('author_activity_band', '1-9', 'Author published 1--9 posts in the dataset'),
    ('author_activity_band', '10-99', 'Author published 10--99 posts in the dataset'),
    ('author_activity_band', '100-999', 'Author published 100--999 posts in the dataset'),
    ('author_activity_band', '1000+', 'Author published at least 1,000 posts in the dataset'),
    ('has_image', 'no', 'Post has no recorded image'),
    ('has_image', 'yes', 'Post has at least one recorded image'),
    ('has_video', 'no', 'Post has no recorded video'),
    ('has_video', 'yes', 'Post has at least one recorded video'),
    ('is_weekend', 'no', 'Post was published Monday--Friday'),
    ('is_weekend', 'yes', 'Post was published Saturday or Sunday')
)
"""


def with_parts(select: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + select


BASE = (ENTRIES, ENGAGEMENT, AUTHORS, FEATURES)
LABELLED = (*BASE, LABELS)
MINED = (*LABELLED, RULES)
MINED_TRIPLES = (*LABELLED, RULES.replace(counted_sets(2), counted_sets(3)))


def text_measures(kind: str, table: str, key: str, column: str) -> str:
    return f"""
        SELECT
            '{kind}' AS kind, {key} AS id, length({column}) AS character_count,
            len(regexp_extract_all({column}, '[[:alnum:]_]+'))::BIGINT AS word_count,
            len(regexp_extract_all({column}, '#[[:alnum:]_]+'))::BIGINT AS hashtag_count,
            len(regexp_extract_all({column}, 'https?://'))::BIGINT AS url_count
        FROM {table}
    """


def shares(column: str, tail: str = "") -> str:
    return f"""
        SELECT
            {column}, count(*) AS posts, avg(engagement_count_7d) AS mean_engagement,
            avg(high_engagement::INTEGER) AS high_engagement_share
        FROM eligible GROUP BY {column} {tail}
    """


def profile() -> str:
    """The exact column measures, one SELECT per column of the labelled features."""
    numbers = (
        "post_id", "author_id", "image_count", "video_count", "character_count", "word_count",
        "hashtag_count", "url_count", "post_hour", "weekday_number", "author_post_count",
        "author_comments_written", "author_likes_given", "connected_service_count",
        "follower_count", "following_count", "new_follower_count", "comment_count_recorded",
        "like_count_recorded", "comment_count_7d", "like_count_7d", "engagement_count_7d",
        "reach_adjusted_engagement",
    )
    others = (
        "posted_at", "source_name", "source_group", "has_image", "has_video", "weekday_name",
        "is_weekend", "user_type", "has_profile_description", "network_snapshot_available",
        "has_full_7d_window", "post_length_band", "time_of_day", "follower_band",
        "author_activity_band", "analysis_eligible", "high_engagement",
        "high_reach_adjusted_engagement",
    )
    return " UNION ALL ".join(
        f"""
        SELECT
            '{column}' AS column_name,
            min({column})::VARCHAR AS min,
            max({column})::VARCHAR AS max,
            {f'round(avg({column}), 6)' if column in numbers else 'NULL::DOUBLE'} AS avg,
            {f'round(stddev_samp({column}), 6)' if column in numbers else 'NULL::DOUBLE'} AS std,
            {f'quantile_disc({column}, 0.25)::DOUBLE' if column in numbers else 'NULL::DOUBLE'} AS q25,
            {f'quantile_disc({column}, 0.5)::DOUBLE' if column in numbers else 'NULL::DOUBLE'} AS q50,
            {f'quantile_disc({column}, 0.75)::DOUBLE' if column in numbers else 'NULL::DOUBLE'} AS q75,
            count(DISTINCT {column}) AS distinct_values,
            count(*) AS count,
            round((count(*) - count({column})) * 100.0::DOUBLE / count(*), 2) AS null_percentage
        FROM features
        """
        for column in (*numbers, *others)
    )


GRID = """
, cells AS (
    SELECT min_support, min_confidence
    FROM (VALUES (0.0001::DOUBLE), (0.0005), (0.001), (0.002)) s(min_support),
        (VALUES (0.02::DOUBLE), (0.05), (0.1), (0.2)) c(min_confidence)
),
kept AS (
    SELECT * FROM cells LEFT JOIN candidates
        ON support >= min_support AND confidence >= min_confidence
)
SELECT
    min_support,
    min_confidence,
    round(min_confidence / (SELECT hits1::DOUBLE / eligible_posts FROM totals), 2)
        AS implied_min_lift,
    count(antecedent) AS rules,
    count(antecedent) FILTER (WHERE NOT uses_source) AS rules_without_source,
    coalesce(min(joint_count), 0) AS min_joint_posts,
    coalesce(first(antecedent ORDER BY lift DESC, support DESC, antecedent), '') AS top_rule,
    round(max(lift), 2) AS top_lift
FROM kept GROUP BY min_support, min_confidence
"""


def table_quality(name: str, key: str, lacks: str, time: str | None) -> str:
    """Counts of a raw table in which the key's last digit says which lines lack it, are long or short."""
    outside = f"count(*) FILTER (WHERE {key} % 10 NOT IN (1, 2) AND NOT ({IN_STUDY.format(time)}))"
    return f"""
        SELECT
            '{name}' AS "table",
            count(*) FILTER (WHERE {key} % 10 NOT IN (1, 2)) AS row_count,
            count(*) FILTER (WHERE {key} % 10 = 0 OR {key} % 10 > 2 AND ({lacks})) AS invalid_identifier_rows,
            {outside if time else "NULL::BIGINT"} AS invalid_timestamp_rows,
            count(*) FILTER (WHERE {key} % 10 IN (1, 2)) AS rejected_csv_rows,
            'parquet/clean/{name}' AS parquet_file,
            true AS has_bytes
        FROM {name}
    """


ORACLE: dict[str, str] = {
    "ingest_delimited": with_parts("SELECT * FROM raw", LINES),
    "null_tokens": with_parts(
        r"""
        SELECT
            CASE WHEN field IN ('', '\N', 'null', 'NULL') THEN '(missing)' ELSE field END AS field,
            count(*) AS times
        FROM (SELECT unnest(f) AS field FROM cut) GROUP BY 1
        """,
        LINES,
    ),
    "rejects": with_parts("SELECT * EXCLUDE (part, line) FROM rejected", LINES),
    "numbered_rejects": with_parts("SELECT * EXCLUDE (source_file) FROM rejected", LINES),
    "rejected_line_count": with_parts(
        "SELECT count(DISTINCT (part, line)) AS rejected_csv_rows FROM rejected", LINES
    ),
    "reject_count": with_parts("SELECT count(*) AS rejected_csv_rows FROM rejected", LINES),
    "published_rows": with_parts("SELECT * FROM clean", LINES),
    "clean_typed": with_parts("SELECT * FROM clean", LINES),
    "try_casts": with_parts(
        """
        SELECT
            o_orderkey, try_cast(number AS INTEGER) AS as_int,
            try_cast(number AS DOUBLE) AS as_double, try_cast(time AS TIMESTAMP) AS as_time
        FROM messy
        """,
        MESSY,
    ),
    "quality_flags": with_parts("SELECT * FROM flagged", LINES),
    "quality_summary": with_parts(
        """
        SELECT
            'orders' AS "table", count(*) AS row_count,
            count(*) FILTER (WHERE NOT identifier_is_valid) AS invalid_identifier_rows,
            count(*) FILTER (WHERE NOT timestamp_in_study_window) AS invalid_timestamp_rows,
            (SELECT count(*) FROM rejected) AS rejected_csv_rows
        FROM flagged
        """,
        LINES,
    ),
    "preprocessing_summary": " UNION ALL ".join(
        table_quality(*row)
        for row in (
            ("orders", "o_orderkey", "o_custkey IS NULL", "o_orderdate"),
            ("lineitem", "l_orderkey", "l_partkey IS NULL", "l_shipdate"),
            ("events", "event_id", "user_id IS NULL", "ts"),
            ("customer", "c_custkey", "false", None),
            ("supplier", "s_suppkey", "false", None),
            ("part", "p_partkey", "false", None),
            ("nation", "n_nationkey", "false", None),
        )
    ),
    "first_per_key": """
        SELECT
            l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity,
            l_extendedprice
        FROM lineitem
        QUALIFY row_number() OVER (
            PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate NULLS LAST, l_partkey, l_suppkey, l_quantity, l_extendedprice
        ) = 1
    """,
    "unique_posts": with_parts("SELECT * FROM unique_posts", ENTRIES),
    "inner_join_window_count": with_parts(
        """
        SELECT
            post_id, count(*) AS comment_count_recorded,
            count(*) FILTER (
                WHERE l_shipdate >= posted_at AND l_shipdate < posted_at + INTERVAL 365 DAY
            ) AS comment_count_365d
        FROM lineitem JOIN unique_posts ON l_orderkey = post_id
        GROUP BY post_id
        """,
        ENTRIES,
    ),
    "post_engagement": with_parts("SELECT * FROM engagement", ENTRIES, ENGAGEMENT),
    "post_engagement_colocated": with_parts("SELECT * FROM engagement", ENTRIES, ENGAGEMENT),
    "window_by_month": """
        SELECT l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS row_count,
               sum(l_orderkey)::BIGINT AS key_sum
        FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-02-15' AND l_shipdate < TIMESTAMP '1996-04-01'
        GROUP BY ALL
    """,
    "distinct_authors": "SELECT DISTINCT o_custkey AS author_id FROM orders "
    "WHERE o_custkey IS NOT NULL",
    "author_activity": with_parts("SELECT * FROM activity", ENTRIES, AUTHORS),
    "degree_counts": with_parts(
        """
        SELECT 'following' AS direction, subscriber_id AS node,
            count(DISTINCT subscribed_to_id) AS degree
        FROM subscriptions WHERE subscribed_to_id IS NOT NULL GROUP BY subscriber_id
        UNION ALL
        SELECT 'followers', subscribed_to_id, count(DISTINCT subscriber_id)
        FROM subscriptions WHERE subscribed_to_id IS NOT NULL GROUP BY subscribed_to_id
        """,
        ENTRIES,
    ),
    "author_statistics": with_parts("SELECT * FROM authors", ENTRIES, AUTHORS),
    "strip_tags": """
        SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS visible_text FROM pages
    """,
    "text_features": text_measures("document", "documents", "doc_id", "text")
    + " UNION ALL "
    + text_measures("url", "pages", "page_id", "url"),
    "calendar_features": """
        SELECT
            event_id, hour(ts)::INTEGER AS post_hour, isodow(ts)::INTEGER AS weekday_number,
            strftime(ts, '%A') AS weekday_name, isodow(ts) IN (6, 7) AS is_weekend
        FROM events
    """,
    "bands": """
        SELECT 'length' AS kind, doc_id AS id,
            CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 80 THEN 'short'
                WHEN length(text) < 200 THEN 'medium' WHEN length(text) < 500 THEN 'long'
                ELSE 'very_long' END AS band
        FROM documents
        UNION ALL
        SELECT 'hour', event_id,
            CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning'
                WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END
        FROM events
        UNION ALL
        SELECT 'followers', l_partkey,
            CASE WHEN n IS NULL THEN 'unknown' WHEN n = 0 THEN '0' WHEN n < 10 THEN '1-9'
                WHEN n < 100 THEN '10-99' WHEN n < 1000 THEN '100-999' ELSE '1000+' END
        FROM (
            SELECT l_partkey, sum(l_quantity) FILTER (WHERE l_linenumber <> 7) AS n
            FROM lineitem GROUP BY l_partkey
        )
        UNION ALL
        SELECT 'activity', l_partkey,
            CASE WHEN n < 10 THEN '1-9' WHEN n < 100 THEN '10-99' WHEN n < 1000 THEN '100-999'
                ELSE '1000+' END
        FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)
    """,
    "top_categories": """
        WITH top AS (
            SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 7
        )
        SELECT
            doc_id, source,
            CASE WHEN source IN (SELECT source FROM top) THEN source ELSE 'Other' END
                AS source_group
        FROM documents
    """,
    "post_features": with_parts("SELECT * FROM base", *BASE),
    "post_features_joined": with_parts("SELECT * FROM base", *BASE),
    "thresholds": with_parts("SELECT * FROM limits", *LABELLED),
    "labels": with_parts("SELECT * FROM features", *LABELLED),
    "labels_tied": """
        WITH rows AS (
            SELECT l_returnflag, l_quantity::BIGINT AS engaged, ceil(l_quantity / 10) / 3.0::DOUBLE AS ratio
            FROM lineitem
        ), limits AS (
            SELECT
                greatest(1, quantile_disc(engaged, 0.99)) AS raw, quantile_cont(ratio, 0.99) AS reach
            FROM rows
        )
        SELECT
            l_returnflag, count(*) AS row_count,
            count(*) FILTER (WHERE engaged >= raw) AS high_rows,
            count(*) FILTER (WHERE ratio >= reach) AS high_reach_rows
        FROM rows, limits GROUP BY l_returnflag
    """,
    "feature_metadata": with_parts(
        f"""
        SELECT
            {QUANTILE}::DOUBLE AS high_engagement_quantile,
            raw_threshold AS high_engagement_minimum_count,
            reach_threshold AS high_reach_adjusted_engagement_minimum,
            'posts with positive engagement' AS reach_adjusted_quantile_population,
            7 AS top_source_categories,
            365 AS engagement_window_days,
            strftime(TIMESTAMP '2001-01-01' - INTERVAL 365 DAY, '%Y-%m-%dT%H:%M:%S')
                AS last_full_window_post_time
        FROM limits
        """,
        *LABELLED,
    ),
    "overview": with_parts(
        """
        SELECT
            count(*) AS total_posts,
            count(*) FILTER (WHERE analysis_eligible) AS eligible_posts,
            count(*) FILTER (WHERE analysis_eligible AND engagement_count_7d = 0)
                AS zero_engagement_posts,
            count(*) FILTER (WHERE high_engagement) AS high_engagement_posts,
            avg(engagement_count_7d) FILTER (WHERE analysis_eligible) AS mean_engagement_7d,
            count(*) FILTER (WHERE analysis_eligible AND follower_count IS NULL)
                AS missing_follower_posts,
            quantile_disc(engagement_count_7d, 0.5) FILTER (WHERE analysis_eligible) AS p50,
            quantile_disc(engagement_count_7d, 0.75) FILTER (WHERE analysis_eligible) AS p75,
            quantile_disc(engagement_count_7d, 0.9) FILTER (WHERE analysis_eligible) AS p90,
            quantile_disc(engagement_count_7d, 0.95) FILTER (WHERE analysis_eligible) AS p95,
            quantile_disc(engagement_count_7d, 0.99) FILTER (WHERE analysis_eligible) AS p99
        FROM features
        """,
        *LABELLED,
    ),
    "column_profile": with_parts(profile(), *LABELLED),
    "sketch_profile": " UNION ALL ".join(
        f"""
        SELECT
            '{name}' AS column_name, count(*) AS row_count, {low} AS min, {high} AS max,
            count(DISTINCT {name}) AS distinct_values, true AS distinct_within, {near} AS quartiles_within
        FROM lineitem
        """
        for name, low, high, near in (
            *(
                (name, f"min({name})::DOUBLE", f"max({name})::DOUBLE", "true")
                for name in (
                    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax",
                )
            ),
            *(
                (name, "NULL::DOUBLE", "NULL::DOUBLE", "NULL::BOOLEAN")
                for name in ("l_returnflag", "l_linestatus", "l_shipdate")
            ),
        )
    ),
    "capped_histogram": with_parts(
        """
        SELECT least(engagement_count_7d, 3) AS engagement, count(*) AS posts
        FROM base WHERE analysis_eligible GROUP BY 1
        """,
        *BASE,
    ),
    "profile_by_source": with_parts(
        shares("source_group", "HAVING count(*) >= 100 ORDER BY posts DESC, source_group LIMIT 5"),
        *LABELLED,
    ),
    "profile_by_hour": with_parts(shares("post_hour"), *LABELLED),
    "profile_by_band": with_parts(shares("follower_band"), *LABELLED),
    "category_summary": with_parts(
        f""", singles AS (
            SELECT
                split_part(antecedent, '=', 1) AS feature,
                substr(antecedent, strpos(antecedent, '=') + 1) AS category,
                *
            FROM ({counted_sets(1)})
        )
        SELECT
            feature,
            category,
            CASE
                WHEN feature = 'weekday_name' THEN 'Post was published on ' || category
                WHEN feature = 'source_group' AND category = 'Other'
                    THEN 'Source is outside the 7 most frequent services'
                WHEN feature = 'source_group' THEN 'Post was published through ' || category
                ELSE definition
            END AS definition,
            antecedent_count AS post_count,
            antecedent_author_count AS author_count,
            joint1 AS high_engagement_count,
            joint1::DOUBLE / antecedent_count AS high_engagement_share
        FROM singles LEFT JOIN meanings USING (feature, category)
        """,
        *LABELLED,
        MEANINGS,
    ),
    "rule_counts": with_parts("SELECT * FROM by_target", *MINED),
    "rules": with_parts(
        f""", measured_rules AS (
            SELECT
                *,
                CASE target WHEN '{TARGETS[0]}' THEN hits1 ELSE hits2 END::DOUBLE / eligible_posts
                    AS target_baseline,
                joint_count::DOUBLE / eligible_posts AS support,
                joint_count::DOUBLE / antecedent_count AS confidence
            FROM by_target, totals
        )
        SELECT
            antecedent, target || '=yes' AS consequent, antecedent_size, antecedent_count,
            joint_count, antecedent_author_count, joint_author_count, support, confidence,
            confidence / target_baseline AS lift, target_baseline, eligible_posts
        FROM measured_rules
        WHERE antecedent_count >= 50 AND support >= 0.0005::DOUBLE AND confidence >= 0.02::DOUBLE
            AND confidence / target_baseline >= 1.0::DOUBLE
        """,
        *MINED,
    ),
    "rule_candidates": with_parts("SELECT * FROM candidates", *MINED),
    "sensitivity_grid": with_parts(GRID, *MINED),
    "rules_without_column": with_parts(
        """
        SELECT * FROM candidates
        WHERE NOT uses_source AND support >= 0.0001::DOUBLE AND confidence >= 0.02::DOUBLE
        """,
        *MINED,
    ),
}

ORACLE["frequent_triples"] = with_parts(
    "SELECT * FROM by_target WHERE antecedent_count >= 50", *MINED_TRIPLES
)
ORACLE["rules_of_three"] = ORACLE["rules"].replace(counted_sets(2), counted_sets(3))

ORACLE["ingest_files"] = ORACLE["ingest_delimited"]
ORACLE["stored_rows"] = ORACLE["clean_typed"]
ORACLE["report_rows"] = """
    SELECT source, count(*) AS row_count, format
    FROM documents, (VALUES ('csv'), ('json')) f(format) GROUP BY source, format
"""
