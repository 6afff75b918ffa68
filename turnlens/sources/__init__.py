from turnlens.sources.fixtures import (  # noqa: F401
    act_names, acts, turns, turn_text, schema_slots, templates, raw_turns, prepared_turns,
    decodes, decodes_second_run, table,
)
