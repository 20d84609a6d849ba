"""Where records come from and go to: MessagePack and JSON columns, and files by Spark's own readers."""
