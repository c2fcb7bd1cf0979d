"""studycorpus: course-corpus preparation as Spark DataFrame jobs.

Every public function takes DataFrames and returns DataFrames; ``course_id`` is
the scope key of every table.
"""
