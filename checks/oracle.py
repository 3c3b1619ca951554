"""The same queries said in SQL, from the rules of FIXTURES.md and of each operator.

Each statement stands on the given tables only.
"""

from __future__ import annotations

# Common table expressions: name -> (those it needs, body).
CTE: dict[str, tuple[list[str], str]] = {
    "frames": (
        [],
        """
        SELECT source AS session_id, fs AS frame_seq, CASE WHEN fs > 25 THEN 1 ELSE 0 END AS epoch,
               TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(800 * fs) AS ts,
               CASE WHEN doc_id % 17 = 0 THEN 'error' WHEN doc_id % 101 = 0 THEN 'permission' ELSE 'ok' END AS status,
               doc_id
        FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS fs FROM documents)""",
    ),
    "doc_lines": (
        [],
        """
        SELECT doc_id, lang, unnest(range(len(p))) AS line_no, unnest(p) AS text
        FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS p FROM documents)""",
    ),
    "lines": (
        ["frames", "doc_lines"],
        """
        SELECT f.session_id, f.frame_seq, d.doc_id, d.lang, d.line_no, d.text
        FROM doc_lines d JOIN frames f ON f.doc_id = d.doc_id""",
    ),
    "boxes": (
        ["lines"],
        """
        SELECT *, line_no // 3 AS para_no,
               CASE WHEN (doc_id + line_no) % 3 = 0 THEN 'ttb' ELSE 'ltr' END AS dir,
               (line_no % 4) * CAST(0.25 AS DOUBLE) AS x,
               ((line_no * 7) % 50) / CAST(50 AS DOUBLE) AS y,
               CAST(0.2 AS DOUBLE) AS w, CAST(0.02 AS DOUBLE) AS h
        FROM lines""",
    ),
    "maxi": (
        [],
        """
        SELECT * FROM (VALUES ('en', 'en-Latn-US'), ('fr', 'fr-Latn-FR'), ('de', 'de-Latn-DE'), ('es', 'es-Latn-ES'))
        AS t(lang, maximal)""",
    ),
    "resolved": (
        ["lines", "maxi"],
        """
        SELECT l.*, l.lang AS source, m.maximal AS source_max, l.lang = 'en' AS same_language,
               concat(l.doc_id, ':', l.line_no) AS line_id
        FROM lines l JOIN maxi m ON m.lang = l.lang""",
    ),
    "tm": (
        ["doc_lines", "maxi"],
        """
        SELECT DISTINCT m.maximal AS source, 'lowLatency' AS strategy, 'en' AS target, d.text,
               concat('tm:', d.text) AS translated
        FROM doc_lines d JOIN maxi m ON m.lang = d.lang WHERE d.doc_id % 2 = 0 AND d.lang <> 'en'""",
    ),
    "looked": (
        ["resolved", "tm"],
        """
        SELECT r.*, CASE WHEN r.same_language THEN r.text ELSE t.translated END AS translated,
               NOT r.same_language AND t.translated IS NOT NULL AS cache_hit
        FROM resolved r LEFT JOIN tm t
          ON t.source = r.source_max AND t.text = r.text AND t.strategy = 'lowLatency' AND t.target = 'en'""",
    ),
    "requests": (["looked"], "SELECT * FROM looked WHERE translated IS NULL"),
    "responses": (
        ["requests", "frames"],
        """
        SELECT q.session_id, q.frame_seq, q.line_no, q.source_max, q.text AS source_text,
               CASE WHEN q.k % 13 = 0 THEN 'bad' ELSE q.line_id END AS line_id,
               concat('mt:', q.text) AS text, q.k AS arrival, f.ts + to_milliseconds(q.k % 1600) AS ts
        FROM (SELECT *, length(text) * 31 + length(line_id) AS k FROM requests) q
        JOIN frames f ON f.session_id = q.session_id AND f.frame_seq = q.frame_seq
        WHERE q.k % 5 <> 0""",
    ),
    "matched": (
        ["requests", "responses"],
        """
        SELECT q.line_id, q.source, q.text, r.text AS answer
        FROM requests q JOIN responses r ON r.line_id = q.line_id""",
    ),
    "lexicon": (
        ["doc_lines"],
        """
        SELECT lang AS source, token, concat('lx', token) AS out
        FROM (SELECT lang, unnest(string_split(text, ' ')) AS token FROM doc_lines)
        WHERE length(token) % 2 = 0 GROUP BY lang, token""",
    ),
    "codes": (
        [],
        """
        SELECT doc_id, CASE doc_id % 17 WHEN 0 THEN 'auto' WHEN 1 THEN concat(lang, '-', upper(lang)) WHEN 2 THEN lang
          WHEN 3 THEN 'en-US' WHEN 4 THEN 'zh-Hans' WHEN 5 THEN 'zh-Hant-TW' WHEN 6 THEN 'pt-BR' WHEN 7 THEN ''
          WHEN 8 THEN 'tlh' WHEN 9 THEN 'zh-TW' WHEN 10 THEN 'sw' WHEN 11 THEN 'hy' WHEN 12 THEN 'az' WHEN 13 THEN 'az-IR'
          WHEN 14 THEN 'uz-AF' WHEN 15 THEN 'zh-SG' ELSE 'uz_Cyrl' END AS code
        FROM documents""",
    ),
    "names": (
        [],
        """
        SELECT * FROM (VALUES ('en', 'English'), ('fr', 'French'), ('de', 'German'), ('es', 'Spanish'),
          ('en-US', 'English (US)'), ('en-Latn-US', 'English (United States)'), ('fr-Latn-FR', 'French (France)'),
          ('de-Latn-DE', 'German (Germany)'), ('zh-Hans', 'Chinese, Simplified'), ('pt-BR', 'Portuguese (Brazil)'))
        AS t(code, name)""",
    ),
    "displays": (
        [],
        """
        SELECT r_regionkey AS id, r_regionkey * 1000.0::DOUBLE AS x, 0.0::DOUBLE AS y, 1000.0::DOUBLE AS w,
               800.0::DOUBLE AS h, (1 + r_regionkey % 2)::DOUBLE AS scale
        FROM region""",
    ),
    "rects": (
        [],
        """
        SELECT p_partkey AS rect_id, ((p_partkey * 37) % 5200)::DOUBLE AS x, ((p_partkey * 11) % 700)::DOUBLE AS y,
               (40 + p_size * 10)::DOUBLE AS w, (20 + p_size * 5)::DOUBLE AS h
        FROM part""",
    ),
    "placed": (
        ["rects", "displays"],
        """
        SELECT rect_id, x, y, w, h, display_id FROM (
          SELECT r.*, d.id::BIGINT AS display_id, row_number() OVER (PARTITION BY r.rect_id ORDER BY
            greatest(0, least(r.x + r.w, d.x + d.w) - greatest(r.x, d.x))
              * greatest(0, least(r.y + r.h, d.y + d.h) - greatest(r.y, d.y)) DESC, d.id) AS rk
          FROM rects r CROSS JOIN displays d) WHERE rk = 1""",
    ),
    "windows": (
        [],
        """
        SELECT s_suppkey AS window_id, s_suppkey AS z, s_nationkey AS pid, concat('app', s_nationkey) AS bundle,
               CASE WHEN s_suppkey % 3 = 1 THEN 1 ELSE 0 END AS layer,
               CASE s_suppkey % 10 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE 1.0 END::DOUBLE AS alpha,
               ((s_suppkey * 53) % 4800)::DOUBLE AS x, ((s_suppkey * 29) % 700)::DOUBLE AS y,
               (20 + (s_suppkey * 17) % 600)::DOUBLE AS w, (20 + (s_suppkey * 13) % 400)::DOUBLE AS h
        FROM supplier""",
    ),
    "pickable": (
        ["windows"],
        """
        SELECT window_id, z, x, 800 - (y + h) AS y, w, h FROM windows
        WHERE layer = 0 AND pid <> 3 AND coalesce(alpha, 1) > 0.01 AND w >= 40 AND h >= 40""",
    ),
    "points": (
        [],
        """
        SELECT c_custkey AS point_id, ((c_custkey * 41) % 5000)::DOUBLE AS px, ((c_custkey * 23) % 900)::DOUBLE AS py
        FROM customer""",
    ),
    "good": (
        ["frames"],
        """
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_seq) AS seq,
               lead(ts) OVER (PARTITION BY session_id ORDER BY frame_seq) AS next_ts
        FROM frames WHERE status = 'ok'""",
    ),
    # Identity by a run of frames: a text's k-th occurrence exists in each of them.
    "identified": (
        ["resolved", "good"],
        """
        SELECT *, concat_ws(':', session_id, epoch, first_seq, k, md5(text)) AS ident FROM (
          SELECT *, min(seq) OVER (PARTITION BY session_id, epoch, text, k, run) AS first_seq FROM (
            SELECT *, seq - row_number() OVER (PARTITION BY session_id, epoch, text, k ORDER BY seq) AS run FROM (
              SELECT r.*, g.seq, g.epoch, g.ts, g.next_ts,
                     row_number() OVER (PARTITION BY r.session_id, r.frame_seq, r.text ORDER BY r.line_no) AS k
              FROM resolved r JOIN good g ON g.session_id = r.session_id AND g.frame_seq = r.frame_seq)))""",
    ),
    "fresh": (
        ["responses", "good"],
        """
        SELECT r.* FROM responses r JOIN good g ON g.session_id = r.session_id AND g.frame_seq = r.frame_seq
        WHERE r.ts >= g.ts AND (g.next_ts IS NULL OR r.ts < g.next_ts)""",
    ),
    # What the user does around some frames.
    "live_control": (
        ["frames"],
        """
        SELECT f.session_id, f.ts + to_milliseconds(a.ms) AS ts, f.doc_id * 10 + a.i AS no, a.kind
        FROM frames f JOIN (VALUES (0, -400, 'place'), (1, -100, 'set_live_on'), (2, 300, 'set_live_off'), (3, 500, 'set_live_on'),
          (4, 200, 'dismiss'), (5, 900, 'toggle_overlay'), (6, 1700, 'toggle_live'), (7, 100, 'place'), (8, 250, 'toggle_live'),
          (9, 700, 'toggle_live')) AS a(i, ms, kind)
          ON CASE a.i WHEN 0 THEN f.frame_seq = 1 WHEN 1 THEN f.frame_seq = 26 WHEN 2 THEN f.doc_id % 23 = 0 WHEN 3 THEN f.doc_id % 23 = 0
            WHEN 4 THEN f.doc_id % 29 = 1 WHEN 5 THEN f.doc_id % 29 = 1 WHEN 6 THEN f.status = 'permission' AND f.doc_id % 2 = 0
            WHEN 7 THEN f.status = 'permission' AND f.doc_id % 2 = 1 ELSE f.doc_id % 31 = 2 END""",
    ),
    "live_moments": (
        ["frames", "live_control"],
        """
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, rk, no) AS i FROM (
          SELECT session_id, ts, 0 AS rk, no, kind, NULL::BIGINT AS frame_seq, NULL::VARCHAR AS status FROM live_control
          UNION ALL SELECT session_id, ts, 1, frame_seq, 'capture', frame_seq, status FROM frames)""",
    ),
    # A step per event, by the rules of the live switch: is_cut marks events that take the lines off.
    "live_fold": (
        ["live_moments"],
        """
        SELECT session_id, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, NULL::BIGINT AS frame_seq, NULL::VARCHAR AS status,
               false AS active, false AS live, false AS was_live, false AS is_cut, 0 AS epoch
        FROM (SELECT DISTINCT session_id FROM live_moments)
        UNION ALL
        SELECT e.session_id, e.i, e.ts, e.frame_seq, e.status, e.a, e.l, e.live, e.c, e.epoch + e.c::INT FROM (
          SELECT m.session_id, m.i, m.ts, m.frame_seq, m.status, f.live, f.epoch,
            CASE m.kind WHEN 'place' THEN true WHEN 'dismiss' THEN false WHEN 'toggle_overlay' THEN NOT f.active ELSE f.active END AS a,
            CASE m.kind WHEN 'place' THEN true WHEN 'dismiss' THEN false WHEN 'toggle_overlay' THEN NOT f.active
              WHEN 'set_live_off' THEN false WHEN 'set_live_on' THEN f.active
              WHEN 'toggle_live' THEN CASE WHEN f.active THEN NOT f.live ELSE f.live END
              ELSE f.live AND m.status <> 'permission' END AS l,
            CASE m.kind WHEN 'capture' THEN false WHEN 'set_live_on' THEN f.active WHEN 'toggle_live' THEN f.active ELSE true END AS c
          FROM live_fold f JOIN live_moments m ON m.session_id = f.session_id AND m.i = f.i + 1) e""",
    ),
    "live_good": (
        ["live_fold"],
        """
        SELECT session_id, frame_seq, ts, epoch, next_ts, row_number() OVER (PARTITION BY session_id ORDER BY i) AS seq
        FROM (SELECT *, lead(ts) OVER (PARTITION BY session_id ORDER BY i) AS next_ts
              FROM live_fold WHERE is_cut OR (status = 'ok' AND live))
        WHERE status = 'ok'""",
    ),
    "live_identified": (
        ["resolved", "live_good"],
        """
        SELECT *, concat_ws(':', session_id, epoch, first_seq, k, md5(text)) AS ident FROM (
          SELECT *, min(seq) OVER (PARTITION BY session_id, epoch, text, k, run) AS first_seq FROM (
            SELECT *, seq - row_number() OVER (PARTITION BY session_id, epoch, text, k ORDER BY seq) AS run FROM (
              SELECT r.*, g.seq, g.epoch, g.ts, g.next_ts,
                     row_number() OVER (PARTITION BY r.session_id, r.frame_seq, r.text ORDER BY r.line_no) AS k
              FROM resolved r JOIN live_good g ON g.session_id = r.session_id AND g.frame_seq = r.frame_seq)))""",
    ),
    "live_valued": (
        ["live_identified", "looked"],
        """
        SELECT i.*, l.cache_hit, l.translated AS known FROM live_identified i JOIN looked l ON l.line_id = i.line_id""",
    ),
    "live_fresh": (
        ["responses", "live_good"],
        """
        SELECT r.session_id, r.frame_seq, r.line_no, r.ts, r.arrival, r.line_id, g.ts AS shown_at,
               concat('mt:', r.session_id, ':', r.frame_seq, ':', r.source_text) AS answer
        FROM responses r JOIN live_good g ON g.session_id = r.session_id AND g.frame_seq = r.frame_seq
        WHERE r.line_id <> 'bad' AND r.ts >= g.ts AND (g.next_ts IS NULL OR r.ts < g.next_ts)""",
    ),
    "control": (
        [],
        """
        SELECT event_id, ts, user_id, CASE event_type WHEN 'signup' THEN 'place' WHEN 'purchase' THEN 'dismiss'
          WHEN 'view' THEN 'toggle_overlay' WHEN 'click' THEN 'toggle_live' WHEN 'error' THEN 'permission_error' END AS kind,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
        FROM events""",
    ),
    "status_events": (
        [],
        """
        SELECT event_id, ts, user_id, CASE event_id % 35 WHEN 0 THEN 'place' WHEN 7 THEN 'toggle_overlay'
          WHEN 14 THEN 'toggle_live' WHEN 21 THEN 'set_live_on' WHEN 28 THEN 'set_live_off' ELSE
          CASE event_type WHEN 'error' THEN 'translation_failed' WHEN 'signup' THEN 'answer' WHEN 'view' THEN 'good_frame'
            WHEN 'purchase' THEN 'dismiss' WHEN 'click' THEN 'capture_failed' END END AS kind,
          concat('e', event_id) AS message, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
        FROM events""",
    ),
    # Character grams of all documents' lines, add-one smoothing.
    "train": (
        ["doc_lines"],
        """
        SELECT lang, substring(x, i, 3) AS g, count(*) AS c
        FROM (SELECT lang, x, unnest(range(1, greatest(length(x) - 2, 1) + 1)) AS i
              FROM (SELECT lang, lower(text) AS x FROM doc_lines))
        GROUP BY ALL""",
    ),
    "totals": (
        ["train"],
        """
        SELECT l.lang, t.n + v.n AS den FROM (VALUES ('de'), ('en'), ('es'), ('fr')) AS l(lang)
        JOIN (SELECT lang, sum(c)::BIGINT AS n FROM train GROUP BY lang) t ON t.lang = l.lang
        CROSS JOIN (SELECT count(DISTINCT g) AS n FROM train) v""",
    ),
    "model": (
        ["train", "totals"],
        """
        SELECT g.g, t.lang, ln((coalesce(c.c, 0) + 1)::DOUBLE / t.den) AS lp
        FROM (SELECT DISTINCT g FROM train) g CROSS JOIN totals t
        LEFT JOIN train c ON c.g = g.g AND c.lang = t.lang""",
    ),
    "clean": (
        ["lines"],
        r"""
        SELECT * REPLACE (regexp_replace(regexp_replace(text, '^[\p{Z}\t\n\x0B\f\r\x{85}]+', ''),
                                         '[\p{Z}\t\n\x0B\f\r\x{85}]+$', '') AS text)
        FROM lines
        WHERE regexp_replace(text, '[\p{Z}\t\n\x0B\f\r\x{85}]+', '', 'g') <> ''""",
    ),
    "line_texts": (["clean"], "SELECT session_id, frame_seq, line_no, text FROM clean"),
    "frame_texts": (
        ["clean"],
        """
        SELECT session_id, frame_seq, string_agg(text, chr(10) ORDER BY line_no) AS text FROM clean GROUP BY ALL""",
    ),
}


def _scored(texts: str, ids: str) -> str:
    """Best language and confidence of each text of ``texts``."""
    return f"""
        SELECT {ids}, best, confidence FROM (
          SELECT {ids}, arg_max(lang, (s, lang)) AS best,
                 1 / sum(exp(s - m)) AS confidence
          FROM (SELECT *, max(s) OVER (PARTITION BY {ids}) AS m FROM (
            SELECT {ids}, lang, sum(c * lp) / sqrt(sum(c)::DOUBLE) AS s
            FROM (SELECT {ids}, g, count(*) AS c FROM (
                    SELECT {ids}, substring(x, i, 3) AS g
                    FROM (SELECT {ids}, x, unnest(range(1, greatest(length(x) - 2, 1) + 1)) AS i
                          FROM (SELECT {ids}, lower(text) AS x FROM {texts})))
                  GROUP BY ALL) q JOIN model USING (g)
            GROUP BY {ids}, lang))
          GROUP BY {ids})"""


FRAME_IDS, LINE_IDS = "session_id, frame_seq", "session_id, frame_seq, line_no"
CTE["scored_texts"] = (["doc_lines", "model"], _scored("doc_lines", "doc_id, line_no"))
CTE["scored_lines"] = (["line_texts", "model"], _scored("line_texts", LINE_IDS))
CTE["scored_frames"] = (["frame_texts", "model"], _scored("frame_texts", FRAME_IDS))
CTE["sources"] = (
    ["clean", "scored_lines", "scored_frames"],
    """
        SELECT c.*, coalesce(CASE WHEN l.confidence >= 0.65 THEN l.best END, f.best, 'en-US') AS source
        FROM clean c
        LEFT JOIN scored_lines l ON l.session_id = c.session_id AND l.frame_seq = c.frame_seq AND l.line_no = c.line_no
        LEFT JOIN scored_frames f ON f.session_id = c.session_id AND f.frame_seq = c.frame_seq""",
)
def _live_cache(name: str, valued: str, keys: str) -> None:
    """The replay with a cache by ``keys``: the first answer to a key settles which lines were asked for."""
    same = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    CTE[f"{name}_offers"] = (
        [valued, "live_fresh"],
        f"""
        SELECT f.*, v.source_max, v.text, v.epoch, v.k, v.first_seq, min(f.ts) OVER (PARTITION BY {", ".join("v." + k for k in keys.split(", "))}) AS first_said
        FROM live_fresh f JOIN {valued} v ON v.line_id = f.line_id WHERE v.known IS NULL""",
    )
    CTE[f"{name}_told"] = ([f"{name}_offers"], f"SELECT * FROM {name}_offers WHERE shown_at <= first_said")
    CTE[f"{name}_cache"] = (
        [f"{name}_told", valued],
        f"""
        SELECT x.line_id, arg_max(y.answer, (y.ts, y.arrival, y.answer, y.session_id, y.frame_seq, y.line_no)) AS told
        FROM {valued} x JOIN {name}_told y ON {same} AND y.ts < x.ts WHERE x.known IS NULL GROUP BY x.line_id""",
    )
    CTE[name] = (
        [valued, f"{name}_told", f"{name}_cache"],
        f"""
        SELECT *, arg_max(v, seq) FILTER (WHERE v IS NOT NULL)
            OVER (PARTITION BY ident ORDER BY seq ROWS UNBOUNDED PRECEDING) AS translated
        FROM (SELECT x.*, coalesce(x.known, c.told, o.answer) AS v FROM {valued} x
              LEFT JOIN {name}_cache c ON c.line_id = x.line_id
              LEFT JOIN (SELECT line_id, arg_max(answer, (ts, arrival, answer)) AS answer FROM {name}_told GROUP BY line_id) o
                ON o.line_id = x.line_id)""",
    )


CTE["live_auto_valued"] = (
    ["sources", "maxi", "live_identified", "tm"],
    """
        SELECT i.* EXCLUDE (source, source_max, same_language), m.maximal AS source_max, s.source = 'en' AS same_language,
               s.source <> 'en' AND t.translated IS NOT NULL AS cache_hit,
               CASE WHEN s.source = 'en' THEN i.text ELSE t.translated END AS known
        FROM live_identified i
        JOIN sources s ON s.session_id = i.session_id AND s.frame_seq = i.frame_seq AND s.line_no = i.line_no
        LEFT JOIN maxi m ON m.lang = s.source
        LEFT JOIN tm t ON t.source = m.maximal AND t.text = i.text""",
)
_live_cache("live_app", "live_valued", "source_max, text")
_live_cache("live_session", "live_valued", "session_id, source_max, text")
_live_cache("live_none", "live_valued", "session_id, epoch, text, k, first_seq")
_live_cache("live_auto", "live_auto_valued", "source_max, text")
_live_cache("live_auto_session", "live_auto_valued", "session_id, source_max, text")


def _worded(texts: str, ids: str) -> str:
    """Each text of ``texts`` (with a ``source``) word by word through the lexicon."""
    return f"""
        SELECT {ids}, string_agg(coalesce(x.out, t.token), ' ' ORDER BY t.pos) AS translated
        FROM (SELECT {ids}, source, unnest(p) AS token, unnest(range(len(p))) AS pos
              FROM (SELECT {ids}, source, string_split(text, ' ') AS p FROM {texts})) t
        LEFT JOIN lexicon x ON x.source = t.source AND x.token = t.token
        GROUP BY {ids}"""


CTE["worded"] = (["resolved", "lexicon"], _worded("resolved", LINE_IDS))
CTE["worded_sources"] = (["sources", "lexicon"], _worded("sources", LINE_IDS))
CTE["sectioned"] = (
    ["lines"],
    r"""
        SELECT doc_id, section_no,
               any_value(regexp_extract(text, '^(\S+)\.$', 1)) FILTER (WHERE is_head) AS title,
               coalesce(string_agg(text, chr(10) ORDER BY line_no) FILTER (WHERE NOT is_head), '') AS body
        FROM (SELECT *, sum(is_head::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS section_no
              FROM (SELECT *, regexp_matches(text, '^(\S+)\.$') AS is_head FROM lines))
        WHERE section_no > 0 GROUP BY doc_id, section_no""",
)


def _sql(final: str, *needs: str) -> str:
    """``final`` behind the table expressions it needs, in their order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in CTE[name][0]:
                add(n)
            order.append(name)

    for n in needs:
        add(n)
    if not order:
        return final
    return ("WITH RECURSIVE " if "live_fold" in order else "WITH ") + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order) + "\n" + final


def _burst(flush: str) -> str:
    return f"""
        SELECT event_id, user_id, ts FROM (
          SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
        WHERE nxt IS NULL OR nxt > ts + INTERVAL 6 HOUR {flush}"""


# A control state as a chain: the state after event i from the state after event i - 1.
_STATE = """
    WITH RECURSIVE {events},
    fold AS (
      SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS kind, 0 AS active, 0 AS live
      FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL
      SELECT e.user_id, e.i, e.event_id, e.kind,
        CASE e.kind WHEN 'place' THEN 1 WHEN 'dismiss' THEN 0 WHEN 'toggle_overlay' THEN 1 - f.active ELSE f.active END,
        CASE e.kind WHEN 'place' THEN 1 WHEN 'dismiss' THEN 0 WHEN 'toggle_overlay' THEN 1 - f.active
          WHEN 'permission_error' THEN 0
          WHEN 'toggle_live' THEN CASE WHEN f.active = 1 THEN 1 - f.live ELSE f.live END ELSE f.live END
      FROM fold f JOIN control e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT event_id, user_id, kind, active, live FROM fold WHERE i > 0"""

_AVAILABLE = """
    WITH RECURSIVE {events},
    fold AS (
      SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS kind, 0 AS active, 0 AS unavailable,
             NULL::VARCHAR AS last_error
      FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL
      SELECT e.user_id, e.i, e.event_id, e.kind,
        CASE e.kind WHEN 'place' THEN 1 WHEN 'dismiss' THEN 0 WHEN 'toggle_overlay' THEN 1 - f.active ELSE f.active END,
        CASE WHEN e.kind = 'translation_failed' THEN 1
          WHEN e.kind IN ('answer', 'dismiss', 'place', 'toggle_overlay', 'set_live_off') THEN 0
          WHEN e.kind IN ('toggle_live', 'set_live_on') AND f.active = 1 THEN 0 ELSE f.unavailable END,
        CASE WHEN e.kind IN ('translation_failed', 'capture_failed') THEN e.message
          WHEN e.kind IN ('good_frame', 'dismiss') THEN NULL
          WHEN e.kind = 'toggle_overlay' AND f.active = 1 THEN NULL ELSE f.last_error END
      FROM fold f JOIN status_events e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT event_id, user_id, kind, unavailable, last_error FROM fold WHERE i > 0"""

_SPANS = """
    SELECT user_id, start, stop AS "end", n_events FROM (
      SELECT user_id, min(ts) AS start, count(*) FILTER (WHERE kind <> 'end') AS n_events,
             CASE arg_max(kind, (ts, event_id)) WHEN 'end' THEN max(ts) WHEN 'move' THEN max(ts) + INTERVAL 6 HOUR END AS stop
      FROM (SELECT *, sum(opens) OVER w AS span FROM (
        SELECT *, CASE WHEN lag(kind) OVER v = 'begin' OR (lag(kind) OVER v = 'move' AND ts <= lag(ts) OVER v + INTERVAL 6 HOUR)
                       THEN 0 ELSE 1 END AS opens
        FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'begin' WHEN 'purchase' THEN 'end' ELSE 'move' END AS kind FROM events)
        WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id))
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      GROUP BY user_id, span HAVING arg_min(kind, (ts, event_id)) <> 'end')
    WHERE {where}"""

_PIXELS = """
    SELECT session_id, frame_seq, line_no, round(x * 1920, 6) AS px, round(y * 1080, 6) AS py,
           round((1 - (y + h)) * 1080, 6) AS py_up, round(w * 1920, 6) AS pw, round(h * 1080, 6) AS ph
    FROM boxes WHERE doc_id % 7 <> 0 AND text <> ''"""

_FONT = """
    SELECT session_id, frame_seq, line_no, round(CASE WHEN dir = 'ttb' THEN greatest(8, least(fit,
             CASE WHEN line_no % 2 = 1 THEN 0.01::DOUBLE * 1920 ELSE fit END))
           ELSE greatest(8, least(96, ph / greatest(1, line_no % 3) * 0.85::DOUBLE)) END, 6) AS font_size
    FROM (SELECT *, sqrt(pw * ph / greatest(1, length(CASE WHEN doc_id % 2 = 0 THEN concat('tm:', text) ELSE text END)))
                 * 0.9::DOUBLE AS fit
          FROM (SELECT *, greatest(1, w * 1920) AS pw,
                       greatest(1, CASE WHEN line_no % 4 = 0 THEN 0.3::DOUBLE ELSE 0.02::DOUBLE END * 1080) AS ph FROM boxes))"""

_PARAGRAPHS = """
    SELECT session_id, frame_seq, para_no, string_agg(text, chr(10) ORDER BY line_no) AS text,
           round(min(x), 6) AS x, round(min(y), 6) AS y,
           round(max(x + w) - min(x), 6) AS w, round(max(y + h) - min(y), 6) AS h, count(*) AS row_count,
           2 * count(*) FILTER (WHERE dir = 'ttb') >= count(*) AS is_vertical,
           round(CASE WHEN 2 * count(*) FILTER (WHERE dir = 'ttb') >= count(*) THEN avg(w) ELSE 0 END, 6) AS char_scale
    FROM boxes GROUP BY session_id, frame_seq, para_no"""

_CATALOG = """
    SELECT row_number() OVER (ORDER BY is_auto DESC, lower(display), code) AS pos, code, display FROM (
      SELECT code, is_auto, CASE WHEN is_auto THEN 'Auto (detect)' ELSE coalesce(name, code) END AS display
      FROM ({codes}) c LEFT JOIN names n USING (code))"""

_STATUS = """
    SELECT session_id, frame_seq, count(*) AS n_lines, count(*) FILTER (WHERE same_language) AS n_same,
           count(*) FILTER (WHERE cache_hit) AS n_hits, count(*) FILTER (WHERE translated IS NULL) AS n_pending,
           bool_or(translated IS NULL) AS is_translating
    FROM {table} GROUP BY session_id, frame_seq"""

_REPLAY = """
    SELECT session_id, frame_seq, line_no, seq, ident AS line_id, source_max, same_language, cache_hit, translated
    FROM {table}"""

_CLEAN_PAD = r"""
    SELECT session_id, frame_seq, line_no, t AS text FROM (
      SELECT session_id, frame_seq, line_no,
        regexp_replace(regexp_replace(p, '^[\p{Z}\t\n\x0B\f\r\x{85}]+', ''), '[\p{Z}\t\n\x0B\f\r\x{85}]+$', '') AS t
      FROM (SELECT *, CASE WHEN (doc_id + line_no) % 11 = 0 THEN concat('  ', chr(9))
              WHEN (doc_id + line_no) % 3 = 0 THEN concat(chr(12288), chr(32), chr(8195), text, chr(133), ' ', chr(9), ' ')
              ELSE text END AS p FROM lines))
    WHERE t <> ''"""

_DATED = r"""
    SELECT doc_id, section_no, trim(h) AS title,
           CASE WHEN n9 THEN '2024-01-05' ELSE '' END AS date,
           regexp_replace(regexp_replace(body, '^[\p{Z}\t\n\x0B\f\r\x{FEFF}]+', ''), '[\p{Z}\t\n\x0B\f\r\x{FEFF}]+$', '') AS body
    FROM (
      SELECT doc_id, section_no, bool_or(is_head AND n % 9 = 0) AS n9, any_value(text) FILTER (WHERE is_head) AS h,
             coalesce(string_agg(concat(chr(160), text), chr(10) ORDER BY line_no) FILTER (WHERE NOT is_head), '') AS body
      FROM (SELECT *, sum(is_head::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS section_no
            FROM (SELECT *, doc_id + line_no AS n, ((doc_id + line_no) % 9 = 0 OR (doc_id + line_no) % 7 = 0) AS is_head
                  FROM lines))
      WHERE section_no > 0 GROUP BY doc_id, section_no)"""

_SLUGS = r"""
    SELECT doc_id, section_no, title, CASE WHEN k = 1 THEN s ELSE concat(s, '-', k - 1) END AS slug FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY section_no) AS k FROM (
        SELECT doc_id, section_no, concat(' ', title, ' - A!') AS title,
          -- Letters outside ASCII go, then the white space and hyphens around "-" become one hyphen.
          concat(regexp_replace(lower(title), '[^A-Za-z0-9_-]', '', 'g'), '-a') AS s
        FROM sectioned))"""

ORACLE: dict[str, str] = {
    "read_lines": "SELECT doc_id, lang, length(text) AS n FROM documents",
    "lines_from_text": _sql("SELECT doc_id, line_no, text FROM doc_lines", "doc_lines"),
    "latest_region": """
        SELECT user_id, ts, value AS x, value * 2 AS y, 520.0::DOUBLE AS w, 280.0::DOUBLE AS h FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk
          FROM events WHERE event_type = 'signup') WHERE rk = 1""",
    "export_stamped": "SELECT event_id, concat('capture-', strftime(ts, '%Y-%m-%d-%H%M%S')) AS name FROM events",
    "clean_lines": _sql(_CLEAN_PAD, "lines"),
    "flip_boxes": _sql("SELECT session_id, frame_seq, line_no, x, round(1 - (y + h), 6) AS y, w, h FROM boxes", "boxes"),
    "boxes_to_pixels": _sql(_PIXELS, "boxes"),
    "rect_from_drag": """
        SELECT * FROM (SELECT o_orderkey AS drag_id, least(a, c)::DOUBLE AS x, least(b, d)::DOUBLE AS y,
                              abs(a - c)::DOUBLE AS w, abs(b - d)::DOUBLE AS h
          FROM (SELECT o_orderkey, o_orderkey % 640 AS a, o_orderkey % 480 AS b, (o_orderkey * 7) % 640 AS c,
                       (o_orderkey * 3) % 480 AS d FROM orders)) WHERE NOT (w < 8 OR h < 8)""",
    "clip_rects": _sql(
        """
        SELECT p.rect_id, p.display_id, CASE WHEN ok THEN x0 - p.dx END AS clip_x, CASE WHEN ok THEN p.dy + p.dh - y1 END AS clip_y,
               CASE WHEN ok THEN x1 - x0 END AS clip_w, CASE WHEN ok THEN y1 - y0 END AS clip_h
        FROM (SELECT *, x1 > x0 AND y1 > y0 AS ok FROM (
          SELECT r.*, d.x AS dx, d.y AS dy, d.h AS dh, greatest(r.x, d.x) AS x0, greatest(r.y, d.y) AS y0,
                 least(r.x + r.w, d.x + d.w) AS x1, least(r.y + r.h, d.y + d.h) AS y1
          FROM placed r JOIN displays d ON d.id = r.display_id)) p""",
        "placed",
    ),
    "pickable_windows": _sql("SELECT window_id, z, x, y, w, h FROM pickable", "pickable"),
    "line_font_size": _sql(_FONT, "boxes"),
    "paragraph_rollup": _sql(_PARAGRAPHS, "boxes"),
    "paragraph_rollup_padded": _sql(
        r"""
        SELECT session_id, frame_seq, para_no, row_count,
               regexp_replace(regexp_replace(t, '^[\p{Z}\t\n\x0B\f\r\x{85}]+', ''), '[\p{Z}\t\n\x0B\f\r\x{85}]+$', '') AS text
        FROM (SELECT session_id, frame_seq, para_no, count(*) AS row_count,
                     string_agg(CASE WHEN line_no % 3 = 0 THEN concat(chr(12288), ' ', text) ELSE concat(text, ' ', chr(8232)) END,
                                chr(10) ORDER BY line_no) AS t
              FROM boxes WHERE para_no % 5 <> 1 GROUP BY session_id, frame_seq, para_no)""",
        "boxes",
    ),
    "assemble_original": _sql(
        """
        SELECT * FROM (SELECT session_id, frame_seq, string_agg(text, chr(10) ORDER BY line_no) AS original
                       FROM lines GROUP BY ALL) WHERE original <> ''""",
        "lines",
    ),
    "assemble_translation_region": _sql(
        """
        SELECT session_id, frame_seq, string_agg(translated, chr(10) ORDER BY line_no) AS translation
        FROM looked WHERE translated IS NOT NULL GROUP BY ALL HAVING string_agg(translated, '') <> ''""",
        "looked",
    ),
    "assemble_translation_live": _sql(
        """
        SELECT session_id, frame_seq, string_agg(CASE WHEN translated IS NOT NULL THEN translated ELSE text END,
                                                 chr(10) ORDER BY line_no) AS translation
        FROM looked WHERE translated IS NOT NULL OR text <> '' GROUP BY ALL""",
        "looked",
    ),
    "frame_status": _sql(_STATUS.format(table="looked"), "looked"),
    "translation_batches": _sql(
        """
        SELECT session_id, frame_seq, source_max, count(*) AS n,
               string_agg(concat(line_id, '=', text), chr(10) ORDER BY line_no) AS items
        FROM requests GROUP BY session_id, frame_seq, source_max""",
        "requests",
    ),
    "language_profile": _sql(
        """
        SELECT g, round(max(lp) FILTER (WHERE lang = 'de'), 6) AS lp_de, round(max(lp) FILTER (WHERE lang = 'en'), 6) AS lp_en,
               round(max(lp) FILTER (WHERE lang = 'es'), 6) AS lp_es, round(max(lp) FILTER (WHERE lang = 'fr'), 6) AS lp_fr
        FROM model GROUP BY g""",
        "model",
    ),
    "detect_language": _sql(
        """
        SELECT t.doc_id, t.line_no, CASE WHEN s.confidence >= 0.65 THEN s.best END AS detected,
               round(s.confidence, 6) AS confidence
        FROM doc_lines t LEFT JOIN scored_texts s USING (doc_id, line_no)""",
        "scored_texts",
    ),
    "resolve_sources": _sql("SELECT session_id, frame_seq, line_no, source FROM sources", "sources"),
    "normalize_language": _sql(
        """
        SELECT doc_id, code, CASE WHEN code LIKE 'zh%' THEN 'zh' WHEN code LIKE 'pt%' THEN 'pt'
                 WHEN code LIKE '__-__' OR code = 'uz_Cyrl' THEN left(code, 2) ELSE code END AS "primary",
               CASE code WHEN 'en' THEN 'en-Latn-US' WHEN 'fr' THEN 'fr-Latn-FR' WHEN 'de' THEN 'de-Latn-DE'
                 WHEN 'es' THEN 'es-Latn-ES' WHEN 'en-US' THEN 'en-Latn-US' WHEN 'fr-FR' THEN 'fr-Latn-FR'
                 WHEN 'de-DE' THEN 'de-Latn-DE' WHEN 'es-ES' THEN 'es-Latn-ES' WHEN 'en-EN' THEN 'en-Latn-EN'
                 WHEN 'zh-Hans' THEN 'zh-Hans-CN' WHEN 'zh-TW' THEN 'zh-Hant-TW' WHEN 'pt-BR' THEN 'pt-Latn-BR'
                 WHEN 'sw' THEN 'sw-Latn-TZ' WHEN 'hy' THEN 'hy-Armn-AM' WHEN 'az' THEN 'az-Latn-AZ' WHEN 'az-IR' THEN 'az-Arab-IR'
                 WHEN 'uz-AF' THEN 'uz-Arab-AF' WHEN 'zh-SG' THEN 'zh-Hans-SG' WHEN 'uz_Cyrl' THEN 'uz-Cyrl-UZ'
                 ELSE code END AS maximal
        FROM codes""",
        "codes",
    ),
    "language_catalog_source": _sql(
        _CATALOG.format(
            codes="""
          SELECT DISTINCT m.maximal AS code, false AS is_auto FROM documents d JOIN maxi m ON m.lang = d.lang
          WHERE d.lang IN (SELECT regexp_extract(html, '<html lang="([^"]*)"', 1) FROM pages)
          UNION ALL SELECT 'auto', true"""
        ),
        "names",
        "maxi",
    ),
    "language_catalog_target": _sql(
        _CATALOG.format(
            codes="SELECT DISTINCT m.maximal AS code, false AS is_auto FROM documents d JOIN maxi m ON m.lang = d.lang"
        ),
        "names",
        "maxi",
    ),
    "language_display_name": _sql(
        """
        SELECT doc_id, code, CASE WHEN code = 'auto' THEN 'Auto (detect)' ELSE coalesce(name, code) END AS display
        FROM codes LEFT JOIN names USING (code)""",
        "codes",
        "names",
    ),
    "tm_lookup": _sql(
        "SELECT session_id, frame_seq, line_no, source_max, same_language, cache_hit, translated FROM looked", "looked"
    ),
    "pending_lines": _sql("SELECT line_id, source, text FROM requests", "requests"),
    "match_responses": _sql("SELECT line_id, source, text, answer FROM matched", "matched"),
    "apply_translations_region": _sql(
        """
        SELECT l.line_id, CASE WHEN m.answer IS NOT NULL THEN m.answer WHEN l.translated IS NOT NULL THEN l.translated
                               ELSE l.text END AS translated
        FROM looked l LEFT JOIN matched m ON m.line_id = l.line_id""",
        "looked",
        "matched",
    ),
    "apply_translations_live": _sql(
        """
        SELECT l.line_id, coalesce(m.answer, l.translated) AS translated
        FROM looked l LEFT JOIN matched m ON m.line_id = l.line_id""",
        "looked",
        "matched",
    ),
    "max_overlap_display": _sql("SELECT rect_id, display_id FROM placed", "placed"),
    "topmost_window_at": _sql(
        """
        SELECT p.point_id, arg_min(w.window_id, w.z) AS window_id
        FROM points p LEFT JOIN pickable w ON p.px >= w.x AND p.px < w.x + w.w AND p.py >= w.y AND p.py < w.y + w.h
        GROUP BY p.point_id""",
        "points",
        "pickable",
    ),
    "topmost_window_at_snapshots": _sql(
        """
        SELECT p.point_id, p.point_id % 5 AS snapshot, arg_min(w.window_id, w.z) AS window_id
        FROM points p LEFT JOIN (SELECT window_id, z, (window_id + j) % 5 AS snapshot, x + 7.0::DOUBLE * j AS x, y, w, h
                                 FROM pickable, range(3) AS t(j)) w
          ON w.snapshot = p.point_id % 5 AND p.px >= w.x AND p.px < w.x + w.w AND p.py >= w.y AND p.py < w.y + w.h
        GROUP BY p.point_id""",
        "points",
        "pickable",
    ),
    "max_overlap_display_snapshots": _sql(
        """
        SELECT rect_id, snapshot, display_id FROM (
          SELECT r.rect_id, d.snapshot, d.id::BIGINT AS display_id, row_number() OVER (PARTITION BY r.rect_id ORDER BY
            greatest(0, least(r.x + r.w, d.x + d.w) - greatest(r.x, d.x))
              * greatest(0, least(r.y + r.h, d.y + d.h) - greatest(r.y, d.y)) DESC, d.id) AS rk
          FROM rects r JOIN (SELECT *, (id + j) % 5 AS snapshot FROM (SELECT id, x + 7.0::DOUBLE * j AS x, y, w, h, j
                             FROM displays, range(3) AS t(j))) d ON d.snapshot = r.rect_id % 5) WHERE rk = 1""",
        "rects",
        "displays",
    ),
    "first_intersecting_display_snapshots": _sql(
        """
        SELECT w.window_id, w.window_id % 5 AS snapshot, min(d.id)::BIGINT AS display_id, coalesce(arg_min(d.scale, d.id), 2) AS scale
        FROM windows w LEFT JOIN (SELECT id, scale, (id + j) % 5 AS snapshot, x + 7.0::DOUBLE * j AS x, y, w, h
                                  FROM displays, range(3) AS t(j)) d
          ON d.snapshot = w.window_id % 5 AND w.x < d.x + d.w AND d.x < w.x + w.w AND w.y < d.y + d.h AND d.y < w.y + w.h
        GROUP BY w.window_id""",
        "windows",
        "displays",
    ),
    "first_intersecting_display": _sql(
        """
        SELECT w.window_id, min(d.id)::BIGINT AS display_id, coalesce(arg_min(d.scale, d.id), 2) AS scale
        FROM windows w LEFT JOIN displays d
          ON w.x < d.x + d.w AND d.x < w.x + w.w AND w.y < d.y + d.h AND d.y < w.y + w.h
        GROUP BY w.window_id""",
        "windows",
        "displays",
    ),
    "exclude_windows_by_app": _sql("SELECT window_id, pid FROM windows WHERE bundle <> 'app3'", "windows"),
    "exclude_windows_by_id": _sql("SELECT window_id, pid FROM windows WHERE window_id NOT IN (1, 2, 5)", "windows"),
    "drop_stale_responses": _sql(
        "SELECT line_id, session_id, frame_seq, text, arrival, ts FROM fresh", "fresh"
    ),
    "line_identity": _sql(
        "SELECT session_id, frame_seq, line_no, seq, epoch, k, first_seq, ident AS line_id FROM identified", "identified"
    ),
    "frame_diff": _sql(
        """
        SELECT coalesce(c.session_id, p.session_id) AS session_id, coalesce(c.epoch, p.epoch) AS epoch,
               coalesce(c.seq, p.seq + 1) AS seq, coalesce(c.text, p.text) AS text, coalesce(c.k, p.k) AS k,
               CASE WHEN p.session_id IS NULL THEN 'added' WHEN c.session_id IS NULL THEN 'removed' ELSE 'kept' END AS change,
               coalesce(c.line_no, p.line_no) AS line_no, coalesce(c.x, p.x) AS x, coalesce(c.y, p.y) AS y
        FROM placed_lines c FULL JOIN (
          SELECT * FROM placed_lines q WHERE EXISTS (
            SELECT 1 FROM good g WHERE g.session_id = q.session_id AND g.epoch = q.epoch AND g.seq = q.seq + 1)) p
          ON p.session_id = c.session_id AND p.epoch = c.epoch AND p.text = c.text AND p.k = c.k AND p.seq + 1 = c.seq""",
        *[],
    ),
    "carry_forward": _sql(
        """
        SELECT session_id, frame_seq, line_no, ident AS line_id,
               arg_max(v, seq) FILTER (WHERE v IS NOT NULL)
                 OVER (PARTITION BY ident ORDER BY seq ROWS UNBOUNDED PRECEDING) AS translated
        FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN concat(seq, ':', text) END AS v FROM identified)""",
        "identified",
    ),
    "changes_only": """
        SELECT event_id, user_id, event_type FROM (
          SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
        WHERE event_type IS DISTINCT FROM p""",
    "session_state": _STATE.format(events=f"control AS ({CTE['control'][1]})"),
    "availability_status": _AVAILABLE.format(events=f"status_events AS ({CTE['status_events'][1]})"),
    "debounce_last": _burst(""),
    "debounce_last_flush": _burst("OR event_type = 'purchase'"),
    "interaction_spans": """
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n_events FROM (
          SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS span FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR
                           THEN 0 ELSE 1 END AS opens FROM events))
        GROUP BY user_id, span""",
    "interaction_spans_begin_end": _SPANS.format(where="true"),
    "interaction_stream": _SPANS.format(where="stop IS NOT NULL"),
    "sample_latest": """
        SELECT user_id, date_trunc('hour', ts) AS tick, ts, event_id, event_type FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS rk
          FROM events) WHERE rk = 1""",
    "tm_upsert": _sql(
        """
        SELECT source, 'lowLatency' AS strategy, 'en' AS target, text, translated FROM (
          SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY fresh DESC, arrival DESC) AS rk FROM (
            SELECT source, text, translated, 0 AS fresh, 0 AS arrival FROM tm
            UNION ALL SELECT source_max, source_text, text, 1, arrival FROM responses)) WHERE rk = 1""",
        "tm",
        "responses",
    ),
    "route_errors": _sql(
        """
        SELECT session_id, frame_seq, status, CASE WHEN status = 'ok' THEN 'pipeline' ELSE 'dead_letter' END AS route,
               status = 'permission' AS fatal FROM frames""",
        "frames",
    ),
    "lexicon_translate": _sql("SELECT * FROM worded", "worded"),
    "translate_batches": _sql(
        "SELECT line_id, source_max, text, concat('mt:', text) AS answer, NULL::VARCHAR AS error FROM requests", "requests"
    ),
    "split_sections": _sql(
        r"""
        SELECT doc_id, section_no, title, '' AS date,
               regexp_replace(regexp_replace(body, '^[\p{Z}\t\n\x0B\f\r\x{FEFF}]+', ''),
                              '[\p{Z}\t\n\x0B\f\r\x{FEFF}]+$', '') AS body FROM sectioned""",
        "sectioned",
    ),
    "split_sections_dated": _sql(_DATED, "lines"),
    "unique_slugs": _sql(_SLUGS, "sectioned"),
    "live_trigger": _sql(
        r"""
        SELECT doc_id, line_no, t AS text FROM (
          SELECT doc_id, line_no, regexp_replace(regexp_replace(text, '^[\p{Z}\t\n\x0B\f\r\x{85}]+', ''),
                                                 '[\p{Z}\t\n\x0B\f\r\x{85}]+$', '') AS t FROM doc_lines)
        WHERE t <> ''""",
        "doc_lines",
    ),
    "live_translate": _sql(
        "SELECT session_id, frame_seq, line_no, seq, ident AS line_id, source_max, translated FROM live_session",
        "live_session",
    ),
    "live_translate_auto": _sql(
        "SELECT session_id, frame_seq, line_no, seq, ident AS line_id, source_max, translated FROM live_auto_session",
        "live_auto_session",
    ),
    "fresh_responses_stream": _sql(
        "SELECT session_id, frame_seq, line_no, answer, ts, arrival AS no FROM live_fresh", "live_fresh"
    ),
    "live_epochs": _sql(
        """
        SELECT session_id, frame_seq, status, epoch, status = 'permission' AS fatal,
               CASE WHEN NOT was_live THEN 'ignored' WHEN status = 'ok' THEN 'pipeline' ELSE 'dead_letter' END AS route
        FROM live_fold WHERE frame_seq IS NOT NULL""",
        "live_fold",
    ),
    "drop_stale_responses_control": _sql(
        """
        SELECT r.line_id, r.session_id, r.frame_seq, r.text, r.arrival, r.ts
        FROM responses r JOIN live_good g ON g.session_id = r.session_id AND g.frame_seq = r.frame_seq
        WHERE r.ts >= g.ts AND (g.next_ts IS NULL OR r.ts < g.next_ts)""",
        "responses",
        "live_good",
    ),
    "replay_live": _sql(_REPLAY.format(table="live_app"), "live_app"),
    "replay_live_session_cache": _sql(_REPLAY.format(table="live_session"), "live_session"),
    "replay_live_no_cache": _sql(_REPLAY.format(table="live_none"), "live_none"),
    "replay_live_status": _sql(_STATUS.format(table="live_app"), "live_app"),
    "replay_live_auto": _sql(_REPLAY.format(table="live_auto"), "live_auto"),
    "translate_capture": _sql(
        """
        SELECT session_id, frame_seq, string_agg(t, chr(10) ORDER BY line_no) AS translation
        FROM (SELECT s.session_id, s.frame_seq, s.line_no, CASE WHEN s.source LIKE 'en%' THEN s.text ELSE w.translated END AS t
              FROM sources s JOIN worded_sources w
                ON w.session_id = s.session_id AND w.frame_seq = s.frame_seq AND w.line_no = s.line_no)
        GROUP BY session_id, frame_seq""",
        "sources",
        "worded_sources",
    ),
    "translate_capture_failures": _sql(
        """
        SELECT session_id, frame_seq, line_no, CASE WHEN source IN ('fr', 'es') THEN concat('mt:', text) ELSE text END AS translated,
               source = 'de' AS unavailable, CASE WHEN source = 'de' THEN 'RuntimeError: no model' END AS error
        FROM sources""",
        "sources",
    ),
    "translate_capture_lines": _sql(
        """
        SELECT session_id, frame_seq, line_no, 'fr-Latn-FR' AS source_max, false AS same_language,
               concat('mt:', text) AS translated FROM clean""",
        "clean",
    ),
}
CTE["placed_lines"] = (
    ["boxes", "good"],
    """
        SELECT b.*, g.seq, g.epoch, row_number() OVER (PARTITION BY b.session_id, b.frame_seq, b.text ORDER BY b.line_no) AS k
        FROM boxes b JOIN good g ON g.session_id = b.session_id AND g.frame_seq = b.frame_seq""",
)
ORACLE["tm_upsert_stream"] = ORACLE["tm_upsert"]
ORACLE["frame_diff"] = _sql(ORACLE["frame_diff"], "placed_lines")

# Columns that are 32-bit integers in Spark.
_INTEGERS = {
    "read_lines": ["n"],
    "language_catalog_source": ["pos"],
    "language_catalog_target": ["pos"],
    "line_identity": ["line_no", "k"],
    "frame_diff": ["line_no", "k"],
    **{
        name: ["line_no"]
        for name in (
            "lines_from_text", "clean_lines", "flip_boxes", "boxes_to_pixels", "line_font_size", "detect_language",
            "resolve_sources", "tm_lookup", "carry_forward", "lexicon_translate", "live_trigger", "live_translate",
            "live_translate_auto", "fresh_responses_stream",
            "replay_live", "replay_live_session_cache", "replay_live_no_cache", "replay_live_auto", "translate_capture_lines",
            "translate_capture_failures",
        )
    },
}
for _name, _cols in _INTEGERS.items():
    _casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in _cols)
    ORACLE[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLE[_name]})"
ORACLE["normalize_language_table"] = ORACLE["normalize_language"]
