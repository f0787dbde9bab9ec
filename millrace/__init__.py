"""Change-data loops as Spark jobs: delimited text to tables to events and back."""
