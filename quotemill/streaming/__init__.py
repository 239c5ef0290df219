"""An extension: landed files of bars or events as a stream of upserts."""
