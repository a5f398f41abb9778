"""The extract job's configuration file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

#: Fixed value: what begins the line before the object.
MARK = "------------------- TEMP EXTRACT "


@dataclass
class ExtractJob:
    domain: str = ""
    output: str = ""
    names: list[str] = field(default_factory=list)
    id_file: str = ""
    start_id: int = 0
    end_id: int = 0
    template: dict[str, str] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=4)


#: The keys of the file that a job over stored pages uses; connection keys are read over.
KEYS = {"domain": "domain", "output": "output", "id_file": "id_file", "startId": "start_id", "endId": "end_id"}


def _int(value: str) -> int:
    try:
        return int(value)
    except ValueError:
        return 0


def read_config(content: str) -> ExtractJob:
    """`key: value` lines, a line that starts with the mark, then one JSON object with `names` and `css`.

    Unknown keys count for nothing; a number that cannot be read is 0; a missing object leaves names and template empty.
    """
    job, lines = ExtractJob(), iter(content.splitlines())
    for line in lines:
        if line.startswith(MARK):
            break
        key, colon, value = line.partition(":")
        if colon and (name := KEYS.get(key.strip())):
            setattr(job, name, _int(value.strip()) if name in ("start_id", "end_id") else value.strip())
    if body := "".join(lines).strip():
        spec = json.loads(body)
        job.names, job.template = list(spec.get("names", [])), dict(spec.get("css", {}))
    return job


SAMPLE = f"""# an extract job
domain: https://example.org/item/{{id}}
output: items.csv
startId: 1
endId: 100
{MARK}-------------------
{{"names": ["title", "image"], "css": {{"title": "h1.title", "image": "img#main | src"}}}}
"""
