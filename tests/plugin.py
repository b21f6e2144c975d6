"""A sink plugin for the tests: even ids as lines of a file."""

import os
import uuid

from tramline.sources.bridge import Bridge


class ToFile(Bridge):
    def validate(self, row: dict) -> bool:
        return row["id"] % 2 == 0

    def apply(self, row: dict) -> None:
        with open(os.path.join(self.options["folder"], uuid.uuid4().hex), "w") as f:
            f.write(str(row["id"]))
