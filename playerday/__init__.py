"""playerday: player-activity analytics and text-corpus preparation on Spark."""
