"""Bar analytics on Spark: DataFrame operators over keyed, ordered price bars."""
