"""The same queries as SQL for DuckDB, built from shared common table expressions."""

from __future__ import annotations

import re

from speechprep.constants import AUDIO_OFFSET as OFFSET
from speechprep.constants import CODEBOOK, CONTROL_NAMES, PRESETS

WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({strip(x)}, '\\s+'), lambda w: w <> '')"


def ints(x: str) -> str:
    return f"array_to_string({x}, ',')"


def micro(x: str) -> str:
    return f"cast(floor(cast({x} as double) * 1e6 + 0.5) as bigint)"


def micros(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda v: {micro('v')}), ',')"


def word_code(w: str) -> str:
    return f"((ascii({w}) * 31 + length({w}) * 7) % {CODEBOOK})"


def layers_of(source: str, keys: str, text: str) -> str:
    """Three layers made of the words of a text."""
    return f"""
        select {keys}, t,
            list_transform(w[1:t], lambda x: length(x) % 8) as l1,
            list_transform(w[t + 1:3 * t], lambda x: {word_code('x')}) as l2,
            list_transform(w[3 * t + 1:7 * t], lambda x: {word_code('x')}) as l3
        from (
            select {keys}, t,
                list_concat(w, list_transform(range(7 * t - len(w)), lambda i: '')) as w
            from (
                select *, cast((len(w) + 6) // 7 as integer) as t
                from (select *, {words(text)} as w from {source})
            )
        )"""


def codes_of(layers: str, keys: str) -> str:
    cells = ", ".join(
        f"{cell} + {OFFSET + k * CODEBOOK}"
        for k, cell in enumerate(
            ["l1[i + 1]", "l2[2 * i + 1]", "l3[4 * i + 1]", "l3[4 * i + 2]",
             "l2[2 * i + 2]", "l3[4 * i + 3]", "l3[4 * i + 4]"]
        )
    )
    return f"""
        select {keys}, t, l1, l2, l3,
            flatten(list_transform(range(t), lambda i: [{cells}])) as codes
        from {layers}"""


def collapsed_of(codes: str, key: str) -> str:
    """Frames as rows; a repeat is found with a window."""
    return f"""
        select {key}, coalesce(string_agg(frame, ',' order by i) filter (keep), '') as codes,
            count(*) filter (not keep) as removed, count(*) filter (keep) as frames
        from (
            select {key}, i, array_to_string(codes[7 * i + 1:7 * i + 7], ',') as frame,
                lag(codes[7 * i + 1]) over (partition by {key} order by i)
                    is distinct from codes[7 * i + 1] as keep
            from (select {key}, codes, unnest(range(len(codes) // 7)) as i from {codes})
        ) group by {key}"""


def ids_of(source: str, key: str, text: str) -> str:
    """Word ids by the vocabulary, led by start-of-text, as text."""
    return f"""
        select d.{key}, concat_ws(',', '128000', x.ids) as text_ids
        from {source} d left join (
            select {key}, string_agg(cast(coalesce(v.id, 0) as varchar), ',' order by pos) as ids
            from (
                select {key}, unnest(w) as token, generate_subscripts(w, 1) as pos
                from (select {key}, {words(text)} as w from {source})
            ) left join vocab v using (token)
            group by {key}
        ) x using ({key})"""


def slot_walk(streams: str) -> str:
    """The slot-checked walk, one token per step."""
    return f"""
        walk as (
            select doc_id, ids, 0 as i, 0 as k, cast(null as integer) as code from {streams}
            union all
            select doc_id, ids, i + 1,
                case when hit then (k + 1) % 7 else k end,
                case when hit then rel end
            from (
                select doc_id, ids, i, k, ids[i + 1] - {OFFSET} as rel,
                    ids[i + 1] - {OFFSET} between k * {CODEBOOK} and (k + 1) * {CODEBOOK} - 1 as hit
                from walk where i < len(ids)
            )
        ),
        numbered as (
            select doc_id, code, row_number() over (partition by doc_id order by i) as nth,
                count(*) over (partition by doc_id) as total
            from walk where code is not null
        )"""


def walked(streams: str) -> str:
    return f"""
        with recursive {slot_walk(streams)}
        select d.doc_id, coalesce(x.codes, '') as codes from documents d left join (
            select doc_id, string_agg(cast(code as varchar), ',' order by nth) as codes
            from numbered where nth <= total // 7 * 7 group by doc_id
        ) x using (doc_id)"""


TRAIN_HEAD = "128259"
TRAIN_TURN = "128009,128260,128261,128257"
TRAIN_TAIL = "128258,128262"

CTES = {
    "doc_words": f"select doc_id, source, lang, text, {words('text')} as w from documents",
    "doc_layers": layers_of("documents", "doc_id, source, lang, text", "text"),
    "doc_codes": codes_of("doc_layers", "doc_id, source, lang, text"),
    "doc_collapsed": collapsed_of("doc_codes", "doc_id"),
    # Manifest lines.
    "named": """
        select doc_id, lang, source, n, sentence,
            'doc_' || doc_id || '_' || n
                || case lang when 'de' then '.mp3' when 'es' then '.WAV' else '.wav' end as name
        from (
            select doc_id, lang, source, unnest(s) as sentence, generate_subscripts(s, 1) - 1 as n
            from (select *, string_split(text, chr(10)) as s from documents)
        )""",
    "lines": """
        select source as file, doc_id, n, case
            when not contains(sentence, ' ') then name || ','
            when source between 'src10' and 'src14'
                then name || ',"' || replace(sentence, '"', '""') || '"'
            when contains(sentence, '|') then name || ' ' || sentence
            else name || ',' || sentence end as line
        from named
        union all
        select distinct source, -1, 0, 'uuid,sentence' from documents where length(source) = 5""",
    "loose": f"""
        select *, case
            when first and (text is null or whole = 'uuid,sentence') then 'skip'
            when text is null then 'no_comma'
            when not first and (audio = '' or text = '') then 'empty_field'
            when not lower(audio) like '%.wav' then 'bad_extension' end as reason
        from (
            select *, {strip("string_split(whole, ',')[1]")} as audio,
                case when contains(whole, ',')
                    then {strip("substr(whole, strpos(whole, ',') + 1)")} end as text
            from (
                select *, {strip('line')} as whole,
                    row_number() over (partition by file order by doc_id, n) = 1 as first
                from lines
            )
        )""",
    "verdicts": """
        select file, max(len(string_split(regexp_replace(line, '"([^"]|"")*"', '', 'g'), ','))) <= 2
            and arg_min(line, (doc_id, n)) = 'uuid,sentence' as strict
        from lines group by file""",
    "parsed": """
        select file, doc_id, n, line,
            case when strict then string_split(line, ',')[1] else audio end as audio,
            case when strict then s else text end as text,
            case when not strict then reason
                when first then 'skip'
                when s = '' then 'empty_field' end as reason
        from (
            select *, replace(regexp_replace(substr(line, strpos(line, ',') + 1), '^"|"$', '', 'g'),
                '""', '"') as s
            from loose join verdicts using (file)
        )""",
    "kept": "select file, doc_id, n, audio, text from parsed where reason is null",
    "inventory": """
        select '/audio/' || name as path from named semi join labels using (doc_id)""",
    # Vocabulary.
    "vocab": f"""
        select distinct token, ('0x' || md5(token)[1:7])::integer as id
        from (select unnest({words('text')}) as token from benchmark)""",
    "doc_tokens": """
        select doc_id, lang, unnest(w) as token, generate_subscripts(w, 1) - 1 as pos
        from doc_words""",
    # Generated streams.
    "streams": f"""
        select doc_id, source, list_transform(w, lambda x, i: case
            when x like '|%' then 1000 + length(x)
            when length(x) >= 17 then 128257
            when length(x) = 16 then 128258
            else {OFFSET} + ((i - 1 + if(length(x) >= 12, 3, 0)) % 7) * {CODEBOOK}
                + {word_code('x')} end) as ids
        from doc_words""",
    "marked": """
        select *, nullif(len(ids) + 1 - list_position(list_reverse(ids), 128257), len(ids) + 1)
            as mark from streams""",
    "cropped": "select doc_id, source, case when mark is null then ids else ids[mark + 1:] end as ids"
    " from marked",
    "crops": """
        select source, arg_max(mark, doc_id) as crop_at from marked where mark is not null
        group by source""",
    "batch_cropped": """
        select doc_id, case when crop_at is null then ids else ids[crop_at + 1:] end as ids
        from streams left join crops using (source)""",
    "cut": """
        select doc_id, case when stop is null then ids else ids[:stop - 1] end as ids from (
            select *, least(nullif(list_position(ids, 128258), 0),
                nullif(list_position(ids, 128262), 0), nullif(list_position(ids, 128263), 0)) as stop
            from cropped
        )""",
    "batch_cut": """
        select doc_id, case when stop is null then ids else ids[:stop - 1] end as ids from (
            select *, least(nullif(list_position(ids, 128258), 0),
                nullif(list_position(ids, 128262), 0), nullif(list_position(ids, 128263), 0)) as stop
            from batch_cropped
        )""",
    # Waveforms.
    "waves": """
        select vec_id, label, list_transform(embedding,
            lambda x: cast(cast(x as double) * 10 as float)) as samples from embeddings""",
    "quantised": f"""
        select vec_id, t, list_transform(list_concat(embedding, list_transform(
                range(7 * t - len(embedding)), lambda i: cast(0 as float))),
            lambda x: cast(greatest(least(floor((cast(x as double) + 1) * 2047.5), 4095), 0)
                as integer)) as q
        from (select *, cast((len(embedding) + 6) // 7 as integer) as t from embeddings)""",
    "wave_quantised": f"""
        select vec_id, t, list_transform(list_concat(samples, list_transform(
                range(7 * t - len(samples)), lambda i: cast(0 as float))),
            lambda x: cast(greatest(least(floor((cast(x as double) + 1) * 2047.5), 4095), 0)
                as integer)) as q
        from (select *, cast((len(samples) + 6) // 7 as integer) as t from waves)""",
    "wave_codes": codes_of(
        "(select vec_id, t, q[1:t] as l1, q[t + 1:3 * t] as l2, q[3 * t + 1:7 * t] as l3"
        " from wave_quantised)",
        "vec_id",
    ),
    # One second of zeros: 24,000 samples of code 2047, the last frame padded.
    "silent": f"""
        select array_to_string(list_transform(range(3429 * 7),
            lambda i: {OFFSET} + (i % 7) * {CODEBOOK} + 2047), ',') as codes""",
    # Prompts.
    "prompts": """
        select conv_id, turn, case when role <> 'system' then role end as voice, text,
            conv_id || '_' || turn as row from conversations""",
    "voiced": """
        select *, case when voice is not null then voice || ': ' || text else text end as prompt
        from prompts""",
    "prompt_text_ids": ids_of("voiced", "row", "prompt"),
    "prompt_ids": f"""
        select conv_id, turn, row, '{TRAIN_HEAD},' || text_ids || ',{TRAIN_TURN}' as input_ids
        from voiced join prompt_text_ids using (row)""",
    "prompt_sized": """
        select *, len(string_split(input_ids, ',')) as n,
            max(len(string_split(input_ids, ','))) over (partition by conv_id) as m
        from prompt_ids""",
    "turn_layers": layers_of("prompts", "row, conv_id, turn", "text"),
    "turn_codes": codes_of("turn_layers", "row, conv_id, turn"),
    "turn_text_ids": ids_of("prompts", "row", "text"),
    "turn_train": f"""
        select conv_id, turn, concat_ws(',', '{TRAIN_HEAD}', text_ids, '{TRAIN_TURN}',
            {ints('codes')}, '{TRAIN_TAIL}') as ids
        from turn_codes join turn_text_ids using (row)""",
    "turn_sized": """
        select *, len(string_split(ids, ',')) as n,
            max(len(string_split(ids, ','))) over (partition by conv_id) as m from turn_train""",
    "settings": " union all ".join(
        "select '{}' as preset, {} as max_new_tokens, {} as temperature, {} as top_p,"
        " {} as repetition_penalty".format(name, *values.values())
        for name, values in PRESETS.items()
    ),
    # Training rows.
    "doc_text_ids": ids_of("documents", "doc_id", "text"),
    "spoken": "select doc_id, source || ': ' || text as prompt from documents",
    "spoken_ids": ids_of("spoken", "doc_id", "prompt"),
    "doc_train": f"""
        select concat_ws(',', '{TRAIN_HEAD}', text_ids, '{TRAIN_TURN}', codes, '{TRAIN_TAIL}')
            as ids
        from doc_collapsed join spoken_ids using (doc_id) where codes <> ''""",
    "found": "select *, audio as row from kept where '/audio/' || audio in (select path from inventory)",
    "fated": """
        select *, case when not there then 'find' when not coded then case when short then 'decode'
                else 'encode' end when blank then 'encode' when not named then 'tokenise'
                when short then 'decode' end as step,
            case when not there then 'missing_file' when barred then 'a table'
                when short then 'too short' end as error,
            there and coded and not blank and named as trained
        from (
            select '/audio/' || audio as path, text, '/audio/' || audio in (select path from inventory)
                    as there, not contains(text, '|') and '/audio/' || audio in
                    (select path from inventory) as coded, trim(text) = '' as blank,
                contains(text, '|') as barred, length(text) < 40 as short, upper(text) <> text as named
            from kept
        )""",
    "found_layers": layers_of("found", "row", "text"),
    "found_codes": codes_of("found_layers", "row"),
    "found_collapsed": collapsed_of("found_codes", "row"),
    "found_ids": ids_of("found", "row", "text"),
    "found_train": f"""
        select concat_ws(',', '{TRAIN_HEAD}', text_ids, '{TRAIN_TURN}', codes, '{TRAIN_TAIL}')
            as ids
        from found_collapsed join found_ids using (row) where codes <> ''""",
    "block": f"""
        select conv_id, turn, row_number() over (partition by conv_id, turn order by pos) - 1 as idx,
            text
        from (
            select conv_id, turn, {strip('unnest(s)')} as text, generate_subscripts(s, 1) as pos
            from (select *, string_split(text, chr(10)) as s from prompts)
        ) where text <> ''""",
}


def sql(body: str, *extra: str) -> str:
    """``body`` with the expressions it names, and those they name, in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(CTES[name])
                if name not in needed:
                    needed.append(name)

    need(body)
    recursive = body.lstrip().startswith("with recursive ")
    if recursive:
        body = body.lstrip().removeprefix("with recursive ")
    parts = [f"{name} as ({CTES[name]})" for name in needed]
    if recursive:
        return "with recursive " + ",\n".join([*parts, body])
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body


def mask(n: str, m: str, side: str = "left") -> str:
    zeros, one = f"repeat('0,', {m} - {n})", f"rtrim(repeat('1,', {n}), ',')"
    return f"{zeros} || {one}" if side == "left" else f"{one} || repeat(',0', {m} - {n})"


def training(source: str) -> str:
    n = "len(string_split(ids, ','))"
    return f"""select ids as input_ids, ids as labels, rtrim(repeat('1,', {n}), ',')
        as attention_mask from {source}"""


PLAN = """
    select b as batch_id, b * 2000 as start, least(b * 2000 + 2000, n) as "end",
        least(b * 2000 + 2000, n) - b * 2000 as size, total as total_batches,
        5000 // total as steps_per_batch, 5000 // total // 4 as save_steps
    from (select *, unnest(range(total)) as b from (
        select count(*) as n, (count(*) + 1999) // 2000 as total from orders))"""

# Taps of the windowed-sinc resampler at 16 kHz -> 24 kHz (2 samples in, 3 out).
TIME = "((i - 1) / 2.0 - m / 3.0) * 2 * 0.99"
RESAMPLED = f"""
    select vec_id, array_to_string(list_transform(
        list_transform(range(cast(ceil(len(samples) * 3 / 2.0) as bigint)), lambda m:
            cast(list_sum(list_transform(samples, lambda x, i: case
                when abs({TIME}) >= 6 then 0.0
                else cast(x as double) * 0.99 * pow(cos(pi() * ({TIME}) / 12), 2)
                    * case when abs({TIME}) < 1e-12 then 1.0
                        else sin(pi() * ({TIME})) / (pi() * ({TIME})) end
                end)) as float)),
        lambda v: cast(floor(cast(v as double) * 1e4 + 0.5) as bigint)), ',') as samples
    from waves"""

KIND = f"""
    select token, name,
        case when name is not null then 'control'
            when token between {OFFSET} and {OFFSET + 7 * CODEBOOK - 1} then 'audio'
            when token between 0 and 128255 then 'text' else 'unused' end as kind,
        case when token between {OFFSET} and {OFFSET + 7 * CODEBOOK - 1}
            then (token - {OFFSET}) // {CODEBOOK} end as slot
    from (
        select cast(case when l_linenumber = 1 then 128000 + l_suppkey % 300
            when l_linenumber = 2 then l_partkey
            else {OFFSET} + (l_orderkey * 31 + l_partkey) % {7 * CODEBOOK + 500} end as integer)
            as token
        from lineitem
    ) left join (values {", ".join(f"({i}, '{n}')" for i, n in CONTROL_NAMES.items())}) c(token, name)
        using (token)"""


def coverage(source: str) -> str:
    return f"""
        select count(distinct doc_id) as total_texts_analyzed, count(token) as total_tokens,
            count(token) filter (v.token is null) as unk_tokens,
            round((count(token) - count(token) filter (v.token is null)) / count(token) * 100, 6)
                as coverage_rate,
            round(count(token) / count(distinct doc_id), 6) as avg_tokens_per_text
        from {source} left join vocab v using (token)"""


# Rows of files with headers of several kinds; an empty sentence is a fault.
MANIFEST_FILES = f"""
    select kind, audio, text, case when text = '' then 'empty_field' end as reason from (
        select unnest(['quoted', 'wide']) as kind, name as audio, sentence as text from named
        union all select 'whole', 'whole_' || doc_id || '.wav', text from documents where text is not null
        union all select 'plain', name, sentence from named
        where lower(name) like '%.wav' and name not like '%.WAV' and not contains(sentence, '"')
            and sentence <> '' and {strip("sentence")} = sentence
    )
    union all
    select 'raw', audio, coalesce(text, ''), reason from parsed where reason is distinct from 'skip'"""

SQL = {
    "manifest_files": MANIFEST_FILES,
    "manifest_strict": "select name as uuid, sentence from named",
    "manifest_first_comma": "select file, doc_id, n, audio, text from loose where reason is null",
    "manifest_header": "select file, line, coalesce(reason, 'data') as first_line_is"
    " from loose where first",
    "manifest_mode_select": "select file, doc_id, n, audio, text from kept",
    "prompt_lines": "select row_number() over (order by conv_id, turn, idx) - 1 as prompt_id, text"
    " from block",
    "prompt_block_split": "select conv_id, turn, idx, text from block",
    "load_table": "select doc_id, text, 24000 as sampling_rate from documents where lang = 'fr'",
    "rows_to_table": f"select cast(vec_id as varchar) as text, {micros('samples')} as samples,"
    " 24000 as sampling_rate from waves",
    "audio_inventory": "select 'vec_' || vec_id || '.wav' as file_name,"
    " 44 + 4 * len(samples) as length from waves",
    "audio_sizes": "select doc_id, 44 + 4 * len(embedding) as length from documents"
    " left join embeddings on vec_id = doc_id",
    "audio_decode": f"select 'vec_' || vec_id || '.wav' as file_name, {micros('samples')} as samples,"
    " 24000 as source_rate, true as decode_ok from waves",
    "pcm_mono": "select 'vec_' || vec_id || '.wav' as file_name, "
    + micros(
        "list_transform(samples, lambda x: cast(cast(cast(x as double)"
        " + cast(cast(x as double) / 4 as float) as float) as double) / 2)"
    )
    + " as samples from waves",
    "resample": RESAMPLED,
    "write_batches": "select o_orderkey, o_custkey, o_orderstatus,"
    " (row_number() over (order by o_orderkey) - 1) // 2000 as batch_id from orders",
    "write_training_table": training("doc_train"),
    "write_wavs_report": "select vec_id, 'vec_' || vec_id || '.wav' as file_name, true as ok,"
    " cast(null as varchar) as error from waves",
    "output_names": "select 'out/generated_audio_' || printf('%03d', turn + 1) || '.wav' as path"
    " from conversations union all select 'out/order_' || printf('%03d', o_orderkey + 1)"
    " || '.wav' from orders",
    "batch_names": "select conv_id, turn, 'batch_' || printf('%03d', turn + 1) || '_'"
    " || replace(substr(text, 1, 20), ' ', '_') || '.wav' as file_name from conversations",
    "export_manifest": "select 'doc_' || doc_id || '.wav' as file_name from documents where lang <> 'de'",
    "bind_columns": "select name as audio, sentence as text from named",
    "filter_wav": "select doc_id, n, name from named where lang <> 'de'",
    "filter_nonempty": f"""
        select * from (select file, doc_id, n,
            {strip("substr(line, strpos(line, ',') + 1)")} as text from lines where contains(line, ','))
        where text <> ''""",
    "filter_has_codes": f"""
        with recursive line_rows as (select doc_id, n, lang, sentence from named),
        line_layers as ({layers_of('line_rows', 'doc_id, n, lang', 'sentence')}),
        line_codes as ({codes_of('line_layers', 'doc_id, n, lang')})
        select doc_id, n, {ints('codes[8:]')} as codes from line_codes
        where lang <> 'de' and len(codes) > 7""",
    "keep_columns": "select doc_id, lang from documents",
    "drop_on_map": "select doc_id, lang, cast(len(string_split(text, chr(10))) as integer) as lines"
    " from documents",
    "audio_path": "select doc_id, n, case when lang = 'fr' then '/data/' else '/audio/' end || name"
    " as path from named",
    "quarantine": "select file, doc_id, n, line, reason from parsed where reason <> 'skip'",
    "skip_counts": """
        select reason, count(*) as n from (
            select reason from parsed where reason <> 'skip'
            union all
            select 'missing_file' from kept where '/audio/' || audio not in (select path from inventory)
        ) group by reason""",
    "prompt_nonblank": "select doc_id, n from named where contains(sentence, ' ')",
    "manifest_semi_audio": "select '/audio/' || audio as path, text from kept"
    " where '/audio/' || audio in (select path from inventory)",
    "manifest_anti_audio": "select '/audio/' || audio as path, text from kept"
    " where '/audio/' || audio not in (select path from inventory)",
    "attach_audio": """
        select doc_id, 44 + 4 * len(embedding) as bytes, embedding is not null as decode_ok,
            coalesce(len(embedding), 24000) as n_samples
        from documents left join embeddings on vec_id = doc_id""",
    "vocab_lookup": "select doc_id, pos, coalesce(id, 0) as id from doc_tokens left join vocab"
    " using (token)",
    "resolve_params": """
        select conv_id, turn, p.preset,
            coalesce(case when turn > 2 then length(text) end, s.max_new_tokens, 1200)
                as max_new_tokens,
            cast(coalesce(case when length(text) > 500 then 0.3 end, s.temperature, 0.6) as double)
                as temperature,
            cast(coalesce(s.top_p, 0.95) as double) as top_p,
            cast(coalesce(s.repetition_penalty, 1.1) as double) as repetition_penalty
        from (select *, case role when 'user' then 'stable' when 'assistant' then 'expressive'
            else 'unheard_of' end as preset from conversations) p
        left join settings s on s.preset = p.preset""",
    "vocab_coverage": f"""
        select *, case when coverage_rate < 95 then 'low' else 'good' end as coverage_flag
        from ({coverage('doc_tokens')})""",
    "audit_sample": coverage(
        "(select * from doc_tokens where doc_id in"
        " (select doc_id from documents order by doc_id limit 100))"
    ),
    "coverage_flag": """
        select lang, round(rate, 6) as rate, case when rate < 95 then 'low' else 'good' end as flag,
            case when rate + 60 < 95 then 'low' else 'good' end as flag_if_60_more
        from (select lang, count(id) / count(*) * 100 as rate from doc_tokens
            left join vocab using (token) group by lang)""",
    "token_counts": "select token, count(*) as n from doc_tokens group by token",
    "top_tokens": """
        select token, n from (select token, count(*) as n, min((doc_id, pos)) as met
            from doc_tokens group by token) order by n desc, met limit 20""",
    "stage_funnel": """
        select count(*) as manifest_rows, count(*) filter (f) as audio_found,
            count(*) filter (f) as codes_not_null, count(*) filter (f and has) as codes_not_empty,
            count(*) filter (f and has) as frames_left
        from (select '/audio/' || audio in (select path from inventory) as f,
            trim(text) <> '' as has from kept)""",
    "frames_removed": "select cast(sum(removed) as bigint) as removed,"
    " cast(sum(frames) as bigint) as kept from doc_collapsed",
    "batch_plan": PLAN,
    "row_index": "select row_number() over (order by o_orderdate, o_orderkey) - 1 as idx,"
    " o_orderkey, o_custkey from orders",
    "frame_runs": """
        select doc_id, frame, f[1] as c0, f[2] as c1, f[3] as c2, f[4] as c3, f[5] as c4,
            f[6] as c5, f[7] as c6
        from (
            select doc_id, i as frame, codes[7 * i + 1:7 * i + 7] as f,
                lag(codes[7 * i + 1]) over (partition by doc_id order by i) as before
            from (select doc_id, codes, unnest(range(t)) as i from doc_codes)
        ) where before is distinct from f[1]""",
    "batch_max_len": f"select conv_id, max(len({words('text')})) as max_len from conversations"
    " group by conv_id",
    "batch_crop_pos": "select source, crop_at from crops",
    "cap_rows": "select file, doc_id, n, audio, text from kept order by file, doc_id, n limit 5000",
    "cap_rows_numbered": "select o_orderkey, o_custkey from orders order by o_orderkey limit 12000",
    "speaker_prefix": "select doc_id, source || ': ' || text as prompt from documents",
    "voice_prefix": "select conv_id, turn, prompt from voiced",
    "reference_prefix": "select conv_id, turn, '[Voice Reference] ' || text as prompt"
    " from conversations",
    "tokenise": "select doc_id, text_ids from doc_text_ids",
    "tokenise_large_vocab": "select doc_id, text_ids from doc_text_ids",
    "interleave": f"select doc_id, {ints('codes')} as codes from doc_codes",
    "deinterleave": "select doc_id, "
    + ", ".join(f"{ints(c)} as {c}" for c in ("l1", "l2", "l3"))
    + " from doc_codes",
    "collapse_frames": """
        select doc_id, coalesce(c.codes, '') as codes, coalesce(removed, 0) as removed
        from documents left join doc_collapsed c using (doc_id)""",
    "train_sequence": f"""
        select doc_id, ids as input_ids, ids as labels from (
            select doc_id, concat_ws(',', '{TRAIN_HEAD}', text_ids, '{TRAIN_TURN}',
                {ints('codes')}, '{TRAIN_TAIL}') as ids
            from doc_codes join doc_text_ids using (doc_id))""",
    "ones_mask": "select doc_id, rtrim(repeat('1,', 1 + len(w)), ',') as attention_mask"
    " from doc_words",
    "prompt_sequence": "select conv_id, turn, input_ids from prompt_ids",
    "left_pad": f"select conv_id, turn, repeat('128263,', m - n) || input_ids as input_ids,"
    f" {mask('n', 'm')} as attention_mask from prompt_sized",
    "collate": f"select conv_id, turn, ids || repeat(',128263', m - n) as input_ids,"
    f" ids || repeat(',-100', m - n) as labels, {mask('n', 'm', 'right')} as attention_mask"
    " from turn_sized",
    "first_channel": f"select vec_id, {micros('samples')} as samples from waves",
    "peak_normalise": "select vec_id, case when top > 1 then "
    + micros("list_transform(samples, lambda x: cast(cast(x as double) / top as float))")
    + f" else {micros('samples')} end as samples from (select *, cast(greatest(list_max(samples),"
    " -list_min(samples)) as double) as top from waves)",
    "silence": f"""
        with recursive {slot_walk('cut')}
        select d.doc_id, coalesce(x.samples, rtrim(repeat('0,', 1000), ',')) as samples
        from documents d left join (
            select doc_id, string_agg(cast({micro('cast(code / 1000 as float)')} as varchar), ','
                order by nth) as samples
            from numbered where nth <= total // 7 * 7 group by doc_id
        ) x using (doc_id)""",
    "as_float": "select doc_id, "
    + micros("list_transform(w, lambda x: cast(length(x) / 3.0 as float))")
    + " as samples from doc_words",
    "preview": "select doc_id, substr(text, 1, 50) || '...' as preview from documents",
    "crop_after_marker": f"select doc_id, {ints('ids')} as ids from cropped",
    "crop_batchwise": f"select doc_id, {ints('ids')} as ids from batch_cropped",
    "cut_at_stop": f"""
        select doc_id, {ints('case when stop is null then ids else ids[:stop - 1] end')} as ids
        from (select *, nullif(list_position(ids, 128258), 0) as stop from streams)""",
    "extract_codes": walked("cut"),
    "extract_codes_batchwise": walked("batch_cut"),
    "whole_frames": f"select doc_id, {ints('ids[:len(ids) // 7 * 7]')} as ids from streams",
    "classify_token": f"""
        select kind, name, slot, [1, 2, 3, 3, 2, 3, 3][slot + 1] as layer, count(*) as n,
            cast(sum(case when slot is not null then (token - {OFFSET}) % {CODEBOOK} end) as bigint)
                as codes
        from ({KIND}) group by all""",
    "map_rows": "select doc_id, len(string_split(text, chr(10))) as lines from documents",
    "filter_rows": "select doc_id from documents where not contains(text, '|')",
    "safe_map": """
        select doc_id, case when not contains(text, '|') then len(string_split(text, chr(10))) end
            as lines, case when contains(text, '|') then 'a table' end as error from documents""",
    "apply_tokenizer": f"select doc_id, {ints('list_transform(w, lambda x: length(x))')} as text_ids"
    " from doc_words",
    "apply_encoder": f"select vec_id, {ints('q[1:t]')} as l1, {ints('q[t + 1:3 * t]')} as l2,"
    f" {ints('q[3 * t + 1:7 * t]')} as l3 from quantised",
    "encode_files": f"""
        select doc_id, coalesce({ints('w.codes')}, s.codes) as codes
        from documents left join wave_codes w on vec_id = doc_id, silent s""",
    "encode_samples": f"select cast(vec_id as varchar) as text, {ints('codes')} as codes"
    " from wave_codes",
    "apply_decoder": "select vec_id, "
    + micros("list_transform(q, lambda c: cast(c / 2047.5 - 1 as float))")
    + " as samples from quantised",
    "apply_generator": f"""
        select conv_id, turn, '128257,' || array_to_string(list_transform(
            string_split(input_ids, ',')[:case when turn = 0 then 900 else 1200 end],
            lambda x, i: {OFFSET} + ((i - 1) % 7) * {CODEBOOK} + cast(x as integer) % {CODEBOOK}), ',')
            || ',128258' as ids, cast(null as varchar) as error
        from prompt_ids""",
    "ingest_files": MANIFEST_FILES,
    "prepare_manifest": training("found_train"),
    "prepare_table": training("doc_train"),
    "prompt_batches": f"select conv_id, turn, repeat('128263,', m - n) || input_ids as input_ids,"
    f" {mask('n', 'm')} as attention_mask from prompt_sized",
    "slice_orders": PLAN,
    "prepare_faults": """
        select path, text, step, error, trained from fated where step is not null""",
    "prepare_counts": """
        select unnest(['manifest_rows', 'audio_found', 'codes_not_null', 'codes_not_empty',
                'frames_left', 'text_ids_not_null', 'undecodable', 'failed_rows']) as stage,
            unnest([count(*), count(*) filter (there), count(*) filter (coded),
                count(*) filter (coded and not blank), count(*) filter (coded and not blank),
                count(*) filter (coded and not blank and named), count(*) filter (there and short),
                count(*) filter (there and not trained)]) as n
        from fated""",
    "line_batch": "select 'batch_' || printf('%03d', idx + 1) || '_'"
    " || replace(substr(text, 1, 20), ' ', '_') || '.wav' as file_name from block"
    " where length(text) % 7 <> 0",
    "line_faults": """
        select conv_id || '_' || turn as key, idx, text, 'generate' as step,
            'max_new_tokens' as error from block where length(text) % 7 = 0""",
    "generated_audio": f"""
        with recursive {slot_walk('cut')},
        relative as (
            select doc_id, (nth - 1) // 7 as frame, (nth - 1) % 7 as slot,
                code - (nth - 1) % 7 * {CODEBOOK} as value
            from numbered where nth <= total // 7 * 7
        ),
        sounds as (
            select doc_id, list(cast(value / 2047.5 - 1 as float) order by
                case when slot = 0 then 1 when slot in (1, 4) then 2 else 3 end, frame, slot)
                as samples
            from relative group by doc_id
        )
        select 'out/generated_audio_' || printf('%03d', doc_id + 1) || '.wav' as path,
            coalesce({micros('samples')}, rtrim(repeat('0,', 1000), ',')) as samples
        from documents left join sounds using (doc_id)""",
}
SQL = {name: sql(body) for name, body in SQL.items()}

# Columns that are 32-bit in Spark; DuckDB counts and places are 64-bit.
INTEGERS = {
    "prompt_block_split": ["idx"],
    "line_faults": ["idx"],
    "filter_wav": ["n"],
    "filter_has_codes": ["n"],
    "audio_path": ["n"],
    "prompt_nonblank": ["n"],
    "attach_audio": ["bytes", "n_samples"],
    "vocab_lookup": ["pos"],
    "resolve_params": ["max_new_tokens"],
    "frame_runs": ["frame", *[f"c{k}" for k in range(7)]],
    "batch_max_len": ["max_len"],
    "batch_crop_pos": ["crop_at"],
    "collapse_frames": ["removed"],
    "map_rows": ["lines"],
    "safe_map": ["lines"],
}
for name, columns in INTEGERS.items():
    casts = ", ".join(f"cast({c} as integer) as {c}" for c in columns)
    SQL[name] = f"select * replace ({casts}) from ({SQL[name]})"
