"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from sheaf.llm import bpe, leaks, lookalike, reading

QUERIES = {
    "p2_found": lookalike.found,
    "p2_forms": lookalike.forms,
    "p6_ids": bpe.ids,
    "p6_counts": bpe.token_counts,
    "p7_found": leaks.found,
    "p7_reworded": leaks.reworded,
    "p8_found": reading.found,
    "p8_profile": reading.profile,
}


def _translated(text: str, caseless: bool = False) -> str:
    """The form in SQL: look-alikes, full width and radicals by translation, then composition, unseen characters and gaps."""
    pairs = {a: b for a, b in lookalike.LOOKALIKE.items()} | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    pairs |= {chr(c): lookalike._expand(chr(c))[0] for c in range(0x2F00, 0x2FD6)} | {"\u212a": "K"}
    quote = lambda s: s.replace("'", "''")
    form = f"translate(nfc_normalize({text}), '{quote(''.join(pairs))}', '{quote(''.join(pairs.values()))}')"
    form = f"regexp_replace({form}, '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}]', '', 'g')"
    form = f"trim(regexp_replace(nfc_normalize({form}), '[\\s\\p{{Z}}]+', ' ', 'g'))"
    return f"replace(lower({form}), 'ß', 'ss')" if caseless else form


_TEXTS = """texts as (
  select distinct 'paragraph' kind, source grp, item_id id, content as text from inventory_items where kind = 'paragraph' and source is not null and item_id is not null and length(content) > 0
  union select 'cell', table_id::varchar, table_id * 1000 + ord, t from (select table_id, unnest(cell_texts) t, generate_subscripts(cell_texts, 1) - 1 ord from tables_topology) where length(t) > 0)"""
_FORMS = f"with {_TEXTS}, forms as (select *, {_translated('text')} form from texts)"
_LEAKS = f"""with docs as (select doc_id, {_translated('text', True)} f from documents where text is not null), items as (select distinct item_id, lang like 'zh%' zh, {_translated('item_text', True)} f from eval_items where item_text is not null),
  dw as (select doc_id id, regexp_extract_all(f, '[\\p{{L}}\\p{{N}}\\p{{M}}]+') w from docs), iw as (select item_id id, regexp_extract_all(f, '[\\p{{L}}\\p{{N}}\\p{{M}}]+') w from items where not zh),
  dc as (select doc_id id, regexp_replace(f, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g') w from docs where regexp_matches(f, '\\p{{Han}}')), ic as (select item_id id, regexp_replace(f, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g') w from items where zh),
  dwin as (select id, md5(array_to_string(w[i : i + 17], ' ')) h from (select id, w, unnest(range(1, greatest(len(w) - 16, 1))) i from dw)), iwin as (select id, md5(array_to_string(w[i : i + 17], ' ')) h from (select id, w, unnest(range(1, greatest(len(w) - 16, 1))) i from iw)),
  dcin as (select id, md5(substr(w, i, 40)) h from (select id, w, unnest(range(1, greatest(length(w) - 38, 1))) i from dc)), icin as (select id, md5(substr(w, i, 40)) h from (select id, w, unnest(range(1, greatest(length(w) - 38, 1))) i from ic))
  select d.id doc_id, i.id item_id from dwin d join iwin i on d.h = i.h union select d.id, i.id from dcin d join icin i on d.h = i.h"""

SQL = {
    "p2_found": f"{_FORMS} select distinct a.kind, a.id id_a, b.id id_b from forms a join forms b on a.kind = b.kind and a.grp = b.grp and a.form = b.form and a.id < b.id and a.text <> b.text",
    "p2_forms": f"{_FORMS} select distinct kind, id, form from forms",
    "p7_found": _LEAKS,
}
