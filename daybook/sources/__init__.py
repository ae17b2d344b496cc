from daybook.sources.fixtures import Fixtures  # noqa: F401
from daybook.sources.snapshots import latest_snapshot, read_snapshots, snapshot_range, write_snapshots  # noqa: F401
