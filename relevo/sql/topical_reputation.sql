-- Topical reputation: each (author, subreddit) with enough upvotes, and its share of all upvotes.
-- Parameters: :source_table (identifier), :cutoff (timestamp text, session time zone), :min_upvotes (integer).
-- Both uses of "activity" need the same sums, so Spark computes them once and reads the table once.
WITH activity AS (
    SELECT author, subreddit, count(id) AS posts, sum(score) AS upvotes
    FROM IDENTIFIER(:source_table)
    WHERE author IS NOT NULL AND created_utc < CAST(:cutoff AS TIMESTAMP)
    GROUP BY author, subreddit
)
SELECT author, subreddit, CAST(upvotes AS DOUBLE) AS total_upvotes,
       try_divide(CAST(upvotes AS DOUBLE),
                  (SELECT CAST(sum(upvotes) AS DOUBLE) FROM activity HAVING sum(posts) >= 0)) AS topical_focus_score,
       round(ln(posts + 1), 12) AS activity_density
FROM activity
WHERE upvotes >= :min_upvotes
ORDER BY topical_focus_score DESC
