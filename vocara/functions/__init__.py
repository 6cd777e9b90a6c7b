"""Column helpers: functions from Column to Column, all evaluated inside the JVM."""
