"""Column functions: times, levels, keys and durations. All run inside the JVM."""
