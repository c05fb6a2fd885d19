"""DuckDB common table expressions for the derived evidence tables, and the way queries string them together."""

from __future__ import annotations

_CTES = {
    "words": r"SELECT doc_id, n_chars, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda z: z <> '') AS ws FROM documents",
    "items": "SELECT doc_id, len(ws) AS n, unnest(ws) AS str, unnest(range(len(ws))) AS ord FROM words",
    "placed": """SELECT doc_id, n, ord, str, ord // 400 AS page_index, 36e0 + 54 * (ord % 10) AS x, 740e0 - 18 * ((ord // 10) % 40) AS y,
      least(5 * length(str), 50)::DOUBLE AS w FROM items""",
    "boxed": "SELECT doc_id, n, ord, str, page_index, x AS x0, y - 3 AS y0, x + w AS x1, y + 10 AS y1 FROM placed",
    "marks": """SELECT doc_id, k AS mark_no, wi // 400 AS page_index, 35e0 + 54 * (wi % 10) AS x0, 738e0 - 18 * ((wi // 10) % 40) AS y0,
      96e0 + 54 * (wi % 10) AS x1, 749e0 - 18 * ((wi // 10) % 40) AS y1
      FROM (SELECT doc_id, k, (7 * doc_id + 131 * k) % len(ws) AS wi FROM words, (SELECT unnest(range(1, 4)) AS k) WHERE len(ws) > 0)""",
    "hits": """SELECT DISTINCT i.doc_id, i.ord FROM boxed i JOIN marks m ON i.doc_id = m.doc_id AND i.page_index = m.page_index
      AND i.x0 <= m.x1 AND m.x0 <= i.x1 AND i.y0 <= m.y1 AND m.y0 <= i.y1""",
    "cand": "SELECT b.* FROM boxed b LEFT JOIN hits h ON b.doc_id = h.doc_id AND b.ord = h.ord WHERE h.ord IS NULL OR b.doc_id % 10 = 4",
    "counted": "SELECT doc_id, n_chars, len(ws) AS n, (len(ws) + 399) // 400 AS text_pages, (len(ws) + 399) // 400 + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS page_count FROM words",
    "pagelist": "SELECT *, unnest(range(page_count)) AS page_index FROM counted",
    "pages_": """SELECT doc_id, page_index, page_count, page_index < text_pages AS has_text, greatest(least(400, n - 400 * page_index), 0) AS tokens,
      CASE WHEN (doc_id + page_index) % 7 = 0 THEN 1 ELSE 0 END AS image_blocks,
      CASE WHEN (doc_id + page_index) % 7 = 0 THEN ((37 * doc_id + 11 * page_index) % 100) / 100e0 ELSE 0e0 END AS image_coverage,
      90 * ((doc_id + page_index) % 4) AS rotation, CASE WHEN doc_id % 5 = 0 THEN 2e0 ELSE 1e0 END AS user_unit,
      CASE WHEN doc_id % 3 = 0 THEN 36e0 ELSE 0e0 END AS cx0, CASE WHEN doc_id % 3 = 0 THEN 48e0 ELSE 0e0 END AS cy0,
      CASE WHEN doc_id % 3 = 0 THEN 576e0 ELSE 612e0 END AS cx1, CASE WHEN doc_id % 3 = 0 THEN 744e0 ELSE 792e0 END AS cy1,
      greatest(least(400, n - 400 * page_index), 0) * CASE WHEN doc_id % 97 = 0 THEN 100000 ELSE 10 END AS operators,
      CASE WHEN doc_id % 89 = 0 THEN 25000000 ELSE 1000000 END AS max_image_pixels, n_chars * 1000 AS byte_length FROM pagelist""",
    "engine": """SELECT doc_id, page_index, (rotation + CASE WHEN doc_id % 11 = 0 THEN 90 ELSE 0 END) % 360 AS rotation, user_unit,
      (CASE WHEN rotation % 180 <> 0 THEN cy1 - cy0 ELSE cx1 - cx0 END + CASE WHEN doc_id % 17 = 0 THEN 0.05e0 WHEN doc_id % 13 = 0 THEN 0.01e0 ELSE 0e0 END) * user_unit AS width,
      CASE WHEN rotation % 180 <> 0 THEN cx1 - cx0 ELSE cy1 - cy0 END * user_unit AS height,
      (CASE WHEN rotation % 180 <> 0 THEN 792e0 ELSE 612e0 END + CASE WHEN doc_id % 17 = 0 THEN 0.05e0 WHEN doc_id % 13 = 0 THEN 0.01e0 ELSE 0e0 END) * user_unit AS media_width,
      CASE WHEN rotation % 180 <> 0 THEN 612e0 ELSE 792e0 END * user_unit AS media_height,
      CASE WHEN has_text THEN tokens ELSE 0 END AS text_chars, image_blocks, image_coverage
      FROM pages_ WHERE NOT (doc_id % 19 = 0 AND page_index = page_count - 1)""",
    "markctx": "SELECT m.*, p.rotation, p.user_unit, p.cx0, p.cy0, p.cx1, p.cy1 FROM marks m JOIN pages_ p USING (doc_id, page_index)",
    # rectangles cut to the crop box; null where nothing remains
    "cut": "SELECT *, greatest(x0, cx0) AS a, greatest(y0, cy0) AS b, least(x1, cx1) AS c, least(y1, cy1) AS d FROM markctx",
    "view": """SELECT *, CASE rotation WHEN 0 THEN x0 - cx0 WHEN 90 THEN y0 - cy0 WHEN 180 THEN cx1 - x1 ELSE cy1 - y1 END * user_unit AS vx,
      CASE rotation WHEN 0 THEN cy1 - y1 WHEN 90 THEN x0 - cx0 WHEN 180 THEN y0 - cy0 ELSE cx1 - x1 END * user_unit AS vy,
      CASE WHEN rotation % 180 = 0 THEN x1 - x0 ELSE y1 - y0 END * user_unit AS vw, CASE WHEN rotation % 180 = 0 THEN y1 - y0 ELSE x1 - x0 END * user_unit AS vh FROM cut""",
    "features": """SELECT page_id AS doc_id, page_id % 41 = 0 AS xfa, page_id % 37 = 0 AS signed, page_id % 31 = 0 AS form_widgets, page_id % 29 = 0 AS java_script_page,
      page_id % 23 = 0 AS rich_media, page_id % 5 = 0 AS embedded_files, page_id % 7 = 0 AS java_script_document FROM pages""",
    "names": """SELECT page_id AS doc_id, family, side, family || '.' || k AS name FROM pages, (SELECT unnest(['js-actions', 'attachments', 'fields']) AS family),
      (SELECT unnest(['source', 'candidate']) AS side), (SELECT unnest(range(3)) AS k)
      WHERE CASE WHEN side = 'source' THEN k < 2 WHEN page_id % 10 = 2 THEN k < 1 WHEN page_id % 10 = 1 AND family <> 'fields' THEN k < 3 ELSE k < 2 END""",
    "pixels": """SELECT *, CASE WHEN m AND r % 10 = 3 THEN src WHEN m AND r % 10 = 5 THEN 40 WHEN m THEN 0 WHEN r % 10 = 7 AND x = 0 AND y = 0 THEN least(src + 50, 255) ELSE src END AS cand
      FROM (SELECT *, x >= 6 AND x < 26 AND y >= 6 AND y < 26 AS m FROM (SELECT vec_id // 16 AS r, 8 * ((vec_id % 16) % 4) + i % 8 AS x, 8 * ((vec_id % 16) // 4) + i // 8 AS y,
        CAST(floor((CAST(v AS DOUBLE) + 1) * 127.5e0) AS BIGINT) AS src
        FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)))""",
    "segs": """SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seg, CAST(4 * l_quantity AS DOUBLE) AS ax, CAST((7 * l_partkey) % 200 AS DOUBLE) AS ay,
      CAST((13 * l_suppkey) % 200 AS DOUBLE) AS bx, CAST((3 * l_partkey + 17 * l_linenumber) % 200 AS DOUBLE) AS by_, CAST(1 + l_linenumber % 3 AS DOUBLE) AS line_width,
      CAST((11 * l_orderkey) % 160 AS DOUBLE) AS mx0, CAST((17 * l_orderkey) % 160 AS DOUBLE) AS my0,
      CAST((11 * l_orderkey) % 160 + 10 + l_orderkey % 40 AS DOUBLE) AS mx1, CAST((17 * l_orderkey) % 160 + 10 + (3 * l_orderkey) % 40 AS DOUBLE) AS my1 FROM lineitem""",
    "deltas": "SELECT *, bx - ax AS dx, by_ - ay AS dy FROM segs",
    "bounds": """SELECT *, greatest(0e0, CASE WHEN dx > 0 THEN (mx0 - ax) / dx WHEN dx < 0 THEN (mx1 - ax) / dx ELSE 0e0 END, CASE WHEN dy > 0 THEN (my0 - ay) / dy WHEN dy < 0 THEN (my1 - ay) / dy ELSE 0e0 END) AS u0,
      least(1e0, CASE WHEN dx > 0 THEN (mx1 - ax) / dx WHEN dx < 0 THEN (mx0 - ax) / dx ELSE 1e0 END, CASE WHEN dy > 0 THEN (my1 - ay) / dy WHEN dy < 0 THEN (my0 - ay) / dy ELSE 1e0 END) AS u1,
      (dx = 0 AND (ax < mx0 OR ax > mx1)) OR (dy = 0 AND (ay < my0 OR ay > my1)) AS apart FROM deltas""",
    "intervals": "SELECT *, CASE WHEN NOT apart AND u0 <= u1 THEN u0 END AS t0, CASE WHEN NOT apart AND u0 <= u1 THEN u1 END AS t1 FROM bounds",
    "workmsgs": """SELECT event_id AS request_id, props, k, ['OPEN_SOURCE', 'APPLY_REDACTIONS', 'CANDIDATE_READY', 'TRANSFORM_FAILED', 'VERIFY_CANDIDATE', 'VERIFY_CHECKPOINT', 'VERIFY_RESULT', 'VERIFY_FAILED', 'FIND_PAGE'][event_id % 9 + 1] AS type,
      CASE WHEN k % 41 <> 1 THEN octet_length(encode(props)) END AS payload_bytes, CASE WHEN k % 43 <> 1 THEN octet_length(encode(props)) END AS source_bytes,
      CASE WHEN k % 7 = 6 THEN 0 WHEN k % 47 <> 5 THEN 2 END AS rects, octet_length(encode(props)) + CASE WHEN k % 3 = 2 THEN 1 ELSE 0 END AS byte_length,
      CASE k % 53 WHEN 2 THEN upper(sha256(props)) WHEN 3 THEN substr(sha256(props), 1, 63) WHEN 4 THEN NULL ELSE sha256(props) END AS digest,
      CASE WHEN k % 6 = 5 THEN NULL ELSE ['timeout', 'digest-mismatch', 'slow'][k % 3 + 1] END AS reason,
      k % 37 = 0 AS old_transform, k % 37 = 1 AS old_verify, k % 37 = 2 AS old_policy, k % 37 = 3 AS old_redaction, k % 37 = 4 AS old_save,
      k % 11 = 3 OR k % 11 = 5 OR k % 13 = 6 OR k % 13 = 7 OR k % 17 = 4 AS bad_shape, k % 17 = 4 OR k % 19 = 2 AS lacks_field, k % 23 = 9 OR k % 29 = 8 OR k % 31 = 12 AS bad_page FROM (SELECT *, event_id // 9 AS k FROM events)""",
    "msgs": """SELECT event_id AS request_id, user_id AS session, ts,
      ['OPEN_SOURCE', 'RENDER_PAGE', 'EXTRACT_TEXT_PAGE', 'APPLY_REDACTIONS', 'VERIFY_CANDIDATE', 'FIND_PAGE'][event_id % 6 + 1] AS type,
      CASE WHEN event_id % 9 <> 0 THEN event_id % 12 END AS page, value / 20 AS scale, event_id % 9 = 0 AS broken FROM events""",
}


def with_(select: str, *names: str, recursive: bool = False, **more: str) -> str:
    """SQL with the named tables, and those they need, ahead of ``select``. more: further tables, in order."""
    import re

    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for other in _CTES:
            if other != name and re.search(rf"\b{other}\b", _CTES[name]):
                add(other)
        order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({_CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + f"\n{select}" if parts else select
